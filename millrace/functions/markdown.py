"""Structure of one Markdown text: blocks in nested containers, and spans of inline constructs with line and column (SRC18).

A stack of open containers is matched line by line, as CommonMark has it; a paragraph takes lines that leave its containers
(lazy continuation). Each block's characters keep their places, so spans may cross line ends, quote marks and cells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*)")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|[0-9]{1,9}[.)])([ \t]+|$)")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)")
BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
HTML = re.compile(r" {0,3}(?:(?P<comment><!--)|</?(?:address|article|aside|blockquote|body|center|details|dialog|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|html|iframe|li|main|nav|ol|p|picture|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|tr|ul)\b)", re.I)
LONE = re.compile(r" {0,3}</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>[ \t]*$")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(r" {0,3}\[((?:[^\\\[\]]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<((?:[^<>\\\n]|\\.)*)>|([^\s<]\S*))(?:[ \t]*\n?[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)")
AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>")
TAG = re.compile(r"</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>")
TARGET = re.compile(
    r"\(\s*(?:<((?:[^<>\\\n]|\\.)*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)"
)
LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.)*)\]")
TICKS = re.compile("`+")
ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


@dataclass
class Block:
    idx: int
    kind: str
    l0: int
    l1: int
    parent: int | None
    info: str | None = None
    level: int | None = None
    closed: bool | None = None
    list_id: int | None = None
    #: Lines of the block as ``(line, column, text)``.
    parts: list[tuple[int, int, str]] = field(default_factory=list)
    #: Items only: columns that their content is indented, and the mark that tells lists apart.
    indent: int = 0
    mark: str = ""

    def text(self) -> str:
        return "\n".join(s for _, _, s in self.parts)


def unescaped(s: str) -> str:
    return ESCAPED.sub(r"\1", s)


def named(label: str) -> str:
    return " ".join(label.split()).casefold()


def depth(s: str) -> int:
    """Columns of white space that a line begins with; a tab goes to the next fourth."""
    n = 0
    for c in s:
        if c not in " \t":
            break
        n = n + 1 if c == " " else n - n % 4 + 4
    return n


def cells(line: str) -> list[tuple[int, int]]:
    """Where a table row's cells begin and end, white space left out; a bar with a backslash is no border."""
    bars = [m.start() for m in re.finditer(r"\\.|\|", line) if m[0] == "|"]
    edges = [-1, *bars, len(line)]
    spans = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]
    spans = [(a + len(line[a:b]) - len(line[a:b].lstrip()), b - len(line[a:b]) + len(line[a:b].rstrip())) for a, b in spans]
    first = 1 if bars and not line[: bars[0]].strip() else 0
    last = len(spans) - 1 if len(bars) > first and not line[bars[-1] + 1 :].strip() else len(spans)
    return [(a, max(a, b)) for a, b in spans[first:last]]


class Reader:
    """The block pass over one text: ``blocks``, and ``targets`` of its reference definitions."""

    def __init__(self, text: str):
        self.blocks: list[Block] = []
        self.targets: dict[str, str] = {}
        self.open: list[Block] = []
        self.leaf: Block | None = None
        self.last: dict[int | None, Block] = {}
        self.ends: str = ""
        for n, line in enumerate(text.replace("\r\n", "\n").removesuffix("\n").split("\n") if text else [], 1):
            self.line(n, line)
        self.shut(0)

    def add(self, kind: str, n: int, **more) -> Block:
        parent = self.open[-1].idx if self.open else None
        b = Block(len(self.blocks), kind, n, n, parent, **more)
        before = self.last.get(parent)
        if kind == "item":
            same = before is not None and before.kind == "item" and before.mark == b.mark
            b.list_id = before.list_id if same else b.idx
        self.last[parent] = b
        self.blocks.append(b)
        return b

    def done(self) -> None:
        """Close the leaf: definitions at a paragraph's start become blocks of their own."""
        b, self.leaf = self.leaf, None
        if b is None or b.kind not in ("para", "item"):
            return
        while m := DEFINITION.match(b.text()):
            taken = b.parts[: m[0].rstrip("\n").count("\n") + 1]
            self.targets.setdefault(named(m[1]), unescaped(m[2] if m[2] is not None else m[3]))
            b.parts = b.parts[len(taken) :]
            if b.kind == "para" and not b.parts:
                b.kind, b.parts = "refdef", taken
                return
            new = Block(len(self.blocks), "refdef", taken[0][0], taken[-1][0], b.idx if b.kind == "item" else b.parent, parts=taken)
            if b.kind == "para":  # it stands before what is left
                new.idx, b.idx = b.idx, new.idx
                self.blocks[new.idx] = new
                self.blocks.append(b)
                b.l0 = b.parts[0][0]
            else:
                self.blocks.append(new)

    def shut(self, count: int) -> None:
        """Close the containers beyond ``count`` and what is in them."""
        if len(self.open) > count or not count:
            self.done()
            del self.open[count:]

    def line(self, n: int, line: str) -> None:
        at, met = 0, 0
        for c in self.open:
            rest = line[at:]
            if c.kind == "quote":
                if not (m := QUOTE.match(rest)):
                    break
                at += m.end()
            elif rest.strip():
                if depth(rest) < c.indent:
                    break
                at += len(rest) - len(rest.lstrip()) if "\t" in rest[: c.indent] else c.indent
            met += 1
        rest, whole = line[at:], met == len(self.open)
        if whole and self.leaf and self.leaf.kind == "fence":
            mark = self.leaf.mark
            if re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", rest):
                self.leaf.closed, self.leaf.l1, self.leaf = True, n, None
            else:
                self.keep(n, at, rest)
            self.reach(n)
            return
        if whole and self.leaf and self.leaf.kind == "html" and (self.ends or rest.strip()):
            self.keep(n, at, rest)
            if self.ends and self.ends in rest:
                self.leaf = None
            self.reach(n)
            return
        if self.leaf and self.leaf.kind in ("fence", "html") and not whole:
            self.shut(met)
            whole = True
        fresh = False
        while True:
            rest = line[at:]
            para = self.leaf is not None and self.leaf.kind in ("para", "item")
            if not rest.strip():
                break
            if depth(rest) >= 4:
                if not para or fresh:
                    if not (self.leaf and self.leaf.kind == "code" and whole):
                        self.begin(met)
                        self.leaf = self.add("code", n)
                    self.leaf.parts += [(k, 0, "") for k in range(self.leaf.l1 + 1, n)]
                    self.keep(n, at + 4, rest[4:] if rest[:4].isspace() else rest.lstrip())
                    return self.reach(n)
                break
            if m := QUOTE.match(rest):
                self.begin(met)
                self.open.append(self.add("quote", n))
                at, met, fresh, whole = at + m.end(), len(self.open), True, True
            elif m := HEADING.match(rest):
                self.begin(met)
                body = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", rest[m.end() :]).rstrip()
                self.add("heading", n, level=len(m[1]), parts=[(n, at + m.end(), body)])
                return self.reach(n)
            elif m := FENCE.match(rest):
                self.begin(met)
                self.leaf = self.add("fence", n, info=m[2].strip(), closed=False, mark=m[1])
                return self.reach(n)
            elif para and whole and not fresh and self.leaf.parts and (m := UNDERLINE.match(rest)) and self.leaf.kind == "para":
                b = self.leaf
                self.done()
                if b.kind == "para":
                    b.kind, b.level, b.l1 = "heading", 1 if m[1][0] == "=" else 2, n
                    return self.reach(n)
            elif BREAK.match(rest):
                self.begin(met)
                self.last[self.open[-1].idx if self.open else None] = Block(-1, "break", n, n, None)
                return self.reach(n)
            elif (m := ITEM.match(rest)) and not (para and whole and not fresh and (not rest[m.end() :].strip() or m[2] not in "-+*" and int(m[2][:-1]) != 1) and not self.sibling(met)):
                self.begin(met)
                width = depth(m[3]) if 1 <= depth(m[3]) <= 4 and rest[m.end() :].strip() else 1
                item = self.add("item", n, indent=len(m[1]) + len(m[2]) + width, mark=m[2][-1])
                self.open.append(item)
                at, met, fresh, whole = min(len(line), at + len(m[1]) + len(m[2]) + width), len(self.open), True, True
                self.leaf = item
            elif (m := HTML.match(rest)) or (not (para and not fresh) and LONE.match(rest)):  # a lone tag does not end a paragraph
                self.begin(met)
                self.leaf, self.ends = self.add("html", n), "-->" if m and m["comment"] else ""
                self.keep(n, at, rest)
                if self.ends and self.ends in rest:
                    self.leaf = None
                return self.reach(n)
            else:
                break
        if not rest.strip():
            if not whole:
                self.shut(met)
            if self.leaf and self.leaf.kind != "code" and not (fresh and self.leaf.kind == "item"):
                self.done()
            return
        at += len(rest) - len(rest.lstrip())
        rest = rest.strip()
        leaf = self.leaf
        if leaf and leaf.kind in ("para", "item") and leaf.parts:
            if whole and leaf.kind == "para" and len(leaf.parts) == 1 and DELIMITER.match(rest) and "|" in leaf.parts[0][2] + rest and len(cells(rest)) == len(cells(leaf.parts[0][2])):
                leaf.kind = "table_row"
                self.leaf = self.add("table_delim", n, parts=[(n, at, rest)])
            else:
                self.keep(n, at, rest)  # a lazy line, too
                return self.reach(n)
        elif leaf and leaf.kind in ("table_row", "table_delim") and whole and not fresh:
            self.leaf = self.add("table_row", n, parts=[(n, at, rest)])
        elif leaf and leaf.kind == "item" and fresh:
            self.keep(n, at, rest)
        else:
            self.begin(met)
            self.leaf = self.add("para", n)
            self.keep(n, at, rest)
        self.reach(n)

    def sibling(self, met: int) -> bool:
        """Whether the container that a list mark would go into has an item of a list last."""
        b = self.last.get(self.open[met - 1].idx if met else None)
        return b is not None and b.kind == "item" and len(self.open) > met

    def begin(self, met: int) -> None:
        self.done()
        del self.open[met:]

    def keep(self, n: int, at: int, s: str) -> None:
        self.leaf.parts.append((n, at, s))
        self.leaf.l1 = n

    def reach(self, n: int) -> None:
        for c in self.open:
            c.l1 = n


def read(text: str | None) -> Reader:
    r = Reader(text or "")
    r.blocks.sort(key=lambda b: b.idx)
    return r


def md_structure(text: str | None) -> Iterator[tuple]:
    """``(idx, kind, l0, l1, parent, level, info, closed, list_id, text)``: heading, para, item, quote, fence, code, html, refdef, table_row, table_delim.

    The parent is the container. An item's own text is that of the paragraph on the line of its mark. A fence without an end runs to that of its container.
    """
    for b in read(text).blocks:
        yield b.idx, b.kind, b.l0, b.l1, b.parent, b.level, b.info, b.closed, b.list_id, b.text()


def spans(s: str, targets: dict[str, str]) -> list[tuple]:
    """``(outer start, outer end, kind, start, end, text, label)`` in a block's text by offsets."""
    out, stack, i = [], [], 0
    unmet: set[int] = set()
    while i < len(s):
        c = s[i]
        if c == "\\":
            i += 2
        elif c == "`":
            run = TICKS.match(s, i).end() - i
            m = None if run in unmet else re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(s, i + run)
            if m:
                a, b = i + run, m.start()
                if s[a:b].strip() and s[a] in " \n" and s[b - 1] in " \n":
                    a, b = a + 1, b - 1
                out.append((i, m.end(), "code", a, b, s[a:b].replace("\n", " "), None))
                i = m.end()
            else:
                unmet.add(run)
                i += run
        elif c == "<":
            if s.startswith("<!--", i) and (end := s.find("-->", i + 4)) >= 0:
                out.append((i, end + 3, "comment", i + 4, end, s[i + 4 : end].strip(), None))
                i = end + 3
            elif m := AUTO.match(s, i):
                out.append((i, m.end(), "autolink", i + 1, m.end() - 1, m[1] if ":" in m[1] else "mailto:" + m[1], None))
                i = m.end()
            else:
                i = m.end() if (m := TAG.match(s, i)) else i + 1
        elif c == "[":
            image = i > 0 and s[i - 1] == "!" and (i < 2 or s[i - 2] != "\\")
            stack.append([i, image, True])
            i += 1
        elif c == "]" and stack:
            at, image, live = stack.pop()
            label, found = s[at + 1 : i], None
            if live or image:
                m = TARGET.match(s, i + 1)
                if m:
                    g = 1 if m[1] is not None else 2
                    found = (m.end(), "image" if image else "link", m.start(g), m.end(g), unescaped(m[g]))
                else:
                    m = LABEL.match(s, i + 1)
                    a, b = (m.start(1), m.end(1)) if m and m[1].strip() else (at + 1, i)
                    if named(s[a:b]) in targets:
                        found = (m.end() if m else i + 1, "refimage" if image else "reflink", a, b, targets[named(s[a:b])])
            if found:
                out.append((at - image, found[0], found[1], found[2], found[3], found[4], label))
                if not image:
                    for x in stack:
                        x[2] = x[1]
                i = found[0]
            else:
                i += 1
        else:
            i += 1
    return sorted(out, key=lambda x: (x[0], -x[1]))


def md_spans(text: str | None) -> Iterator[tuple]:
    """``(block, cell, kind, l0, c0, l1, c1, o_l0, o_c0, o_l1, o_c1, text, label)``: code, link, image, reflink, refimage, refdef, autolink and comment.

    ``l0`` to ``c1`` are where the code, or the target as written, stands (for references the label looked up), the end not included; ``o_`` the whole construct. In
    table rows ``cell`` is the number of the cell. Nothing in fences, code and html is one but comments.
    """
    r = read(text)
    for b in r.blocks:
        if b.kind in ("para", "heading", "item"):
            sources = [(None, b.text(), [(n, c + k) for n, c, s in b.parts for k in range(len(s) + 1)])]
        elif b.kind == "table_row":
            (n, c, s) = b.parts[0]
            sources = []
            for k, (a, e) in enumerate(cells(s)):
                keep = [p for p in range(a, e) if not (s[p] == "\\" and p + 1 < e and s[p + 1] == "|")]
                sources.append((k, "".join(s[p] for p in keep), [(n, c + p) for p in [*keep, e]]))
        elif b.kind == "html":
            whole, places = b.text(), [(n, c + k) for n, c, s in b.parts for k in range(len(s) + 1)]
            for m in re.finditer(r"<!--(.*?)(?:-->|\Z)", whole, re.S):
                yield b.idx, None, "comment", *places[m.start(1)], *places[m.end(1)], *places[m.start()], *places[m.end()], m[1].strip(), None
            continue
        elif b.kind == "refdef":
            whole, places = b.text(), [(n, c + k) for n, c, s in b.parts for k in range(len(s) + 1)]
            m = DEFINITION.match(whole)
            g = 2 if m[2] is not None else 3
            yield b.idx, None, "refdef", *places[m.start(g)], *places[m.end(g)], *places[0], *places[len(whole.rstrip())], unescaped(m[g]), m[1]
            continue
        else:
            continue
        for cell, s, places in sources:
            for o0, o1, kind, a, e, body, label in spans(s, r.targets):
                yield b.idx, cell, kind, *places[a], *places[e], *places[o0], *places[o1], body, label
