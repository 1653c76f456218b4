"""Table functions over one text: what needs state from line to line and no window can say.

Each is a plain Python generator over a text, wrapped as a UDTF for use with LATERAL; the
generators run per text, so a partition needs memory for one text at a time.
"""

from __future__ import annotations

import ast
import configparser
import json
import re
import tomllib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ship

HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`\n]*)$")
ITEM = re.compile(r"( *)(?:[-*+]|[0-9]{1,9}[.)])[ \t]+(.*)$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
TABLE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def md_blocks(text: str | None) -> Iterator[tuple[int, str, int, int, int | None, str]]:
    """``(idx, kind, l0, l1, parent, text)`` of a Markdown text's blocks; lines from 1, parent the idx of the heading above (SRC18).

    Kinds: heading1 to heading6, para, code, item, quote, table, html, rule. A fence without an
    end runs to the last line.
    """
    lines = (text or "").replace("\r\n", "\n").split("\n")
    if lines and not lines[-1]:
        lines.pop()
    out: list[list] = []
    open_: list | None = None
    above: list[tuple[int, int]] = []

    def add(kind: str, at: int, body: str) -> list:
        row = [len(out), kind, at, at, above[-1][1] if above else None, body]
        out.append(row)
        return row

    n, total = 0, len(lines)
    while n < total:
        line, at = lines[n], n + 1
        n += 1
        if m := FENCE.match(line):
            row, body = add("code", at, m[2].strip()), []
            while n < total and not (re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[n])):
                body.append(lines[n])
                n += 1
            n = min(n + 1, total)
            row[3], row[5], open_ = n, "\n".join(body), None
        elif not line.strip():
            open_ = None
        elif m := HEADING.match(line):
            level = len(m[1])
            while above and above[-1][0] >= level:
                above.pop()
            row, open_ = add(f"heading{level}", at, (m[2] or "").strip()), None
            above.append((level, row[0]))
        elif open_ and open_[1] == "para" and (m := SETEXT.match(line)):
            level = 1 if m[1][0] == "=" else 2
            while above and above[-1][0] >= level:
                above.pop()
            open_[1], open_[3], open_[4] = f"heading{level}", at, above[-1][1] if above else None
            above.append((level, open_[0]))
            open_ = None
        elif open_ and open_[1] == "para" and open_[2] == at - 1 and "|" in open_[5] and "|" in line and TABLE.match(line):
            open_[1], open_[3] = "table", at
            open_[5] += "\n" + line
        elif RULE.match(line):
            add("rule", at, "")
            open_ = None
        elif m := ITEM.match(line):
            open_ = add("item", at, m[2])
        elif line.lstrip().startswith(">"):
            body = re.sub(r"^ {0,3}> ?", "", line)
            if open_ and open_[1] == "quote":
                open_[3], open_[5] = at, open_[5] + "\n" + body
            else:
                open_ = add("quote", at, body)
        elif line.startswith("    ") and not open_:
            open_ = add("code", at, line[4:])
        elif re.match(r" {0,3}</?[A-Za-z!]", line) and not open_:
            open_ = add("html", at, line)
        elif open_ and open_[1] != "rule":
            open_[3] = at
            open_[5] += "\n" + (line[4:] if open_[1] == "code" else line if open_[1] in ("table", "html") else line.strip())
        else:
            open_ = add("para", at, line.strip())
    yield from (tuple(r) for r in out)


INLINE = re.compile(r"(`+)(?P<code>.+?)(?<!`)\1(?!`)|(?P<image>!)?\[(?P<label>[^\]\n]*)\]\((?P<target>[^)\s]+)[^)]*\)|<(?P<auto>https?://[^>\s]+)>")


def line_inlines(line: str) -> Iterator[tuple[int, int, str, str, str | None]]:
    """``(c0, c1, kind, text, target)`` of one line that no code block holds."""
    for m in INLINE.finditer(line):
        if m["code"] is not None:
            yield m.start(), m.end(), "code", m["code"].strip(), None
        elif m["auto"]:
            yield m.start(), m.end(), "link", m["auto"], m["auto"]
        else:
            yield m.start(), m.end(), "image" if m["image"] else "link", m["label"], m["target"]


def md_inlines(text: str | None) -> Iterator[tuple[int, int, int, str, str, str | None]]:
    """``(line, c0, c1, kind, text, target)`` of code spans, links, images and bare links outside code blocks (SRC18, SRC33)."""
    lines = (text or "").replace("\r\n", "\n").split("\n")
    off = {k for _, kind, a, b, *_ in md_blocks(text) if kind == "code" for k in range(a, b + 1)}
    for at, line in enumerate(lines, 1):
        if at in off:
            continue
        for span in line_inlines(line):
            yield at, *span


BLOCK = re.compile(r"\s*(Feature|Background|Rule|Scenario Outline|Scenario|Examples):\s*(.*)$")


def gherkin_blocks(text: str | None) -> Iterator[tuple[str, str, list[str], int, str]]:
    """``(kind, name, tags, line, body)``; tags that stand above a block are its own (SRC19, PRD25)."""
    tags: list[str] = []
    now: list | None = None
    quoted = False
    for at, line in enumerate((text or "").split("\n"), 1):
        s = line.strip()
        if s.startswith('"""'):
            quoted = not quoted
        if not quoted and s.startswith("@"):
            tags += re.findall(r"@[^\s@]+", s)
        elif not quoted and (m := BLOCK.match(line)):
            if now:
                yield now[0], now[1], now[2], now[3], "\n".join(now[4]).strip("\n")
            now, tags = [m[1], m[2].strip(), tags, at, []], []
        elif now is not None:
            now[4].append(line)
    if now:
        yield now[0], now[1], now[2], now[3], "\n".join(now[4]).strip("\n")


def python_definitions(text: str | None) -> Iterator[tuple[str, str, int, int]]:
    """``(name, kind, l0, l1)`` of classes, functions and constants in Python source; none where it does not parse (EXT05)."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return
    todo = [(tree, "")]
    while todo:
        node, prefix = todo.pop(0)
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                name = prefix + x.name
                first = min([x.lineno, *(d.lineno for d in x.decorator_list)])
                yield name, "class" if isinstance(x, ast.ClassDef) else "function", first, x.end_lineno
                if isinstance(x, ast.ClassDef):
                    todo.append((x, name + "."))
            elif isinstance(x, ast.Assign) and node is tree:
                for t in x.targets:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        yield t.id, "constant", x.lineno, x.end_lineno


def braced(lines: list[str], at: int, column: int) -> tuple[list[str], int]:
    """The lines between the brace at a place and the one that closes it, and the number of the last line; to the end without one."""
    depth, body, first = 0, [], True
    for n in range(at, len(lines)):
        start, part = (column if first else 0), lines[n]
        kept = start
        for m in re.finditer(r"[{}]", part[start:]):
            place = start + m.start()
            depth += 1 if m[0] == "{" else -1
            if depth == 1 and m[0] == "{" and first:
                kept, first = place + 1, False
            elif not depth:
                return [*body, part[kept:place]], n
        body.append(part[kept:])
        first = False
    return body, len(lines) - 1


def indented(lines: list[str], at: int) -> tuple[list[str], int]:
    """The lines below a header that are indented more, blank ones included, and the number of the last of them."""
    depth = len(lines[at]) - len(lines[at].lstrip())
    n = at + 1
    while n < len(lines) and (not lines[n].strip() or len(lines[n]) - len(lines[n].lstrip()) > depth):
        n += 1
    return lines[at + 1 : n], n - 1


#: Heads of handlers, and what their bodies say.
HANDLER = re.compile(
    r"^\s*except\b(?P<py>[^:]*):|\bcatch\s*\((?P<brace>[^)]*)\)|\bcatch\s*(?=\{)|\bcatch\s+(?P<bare>[A-Za-z_]\w*)\s*(?=\{|$)"
    r"|\bif\b[^{]*?\b(?P<error>\w*[eE]rr\w*)\s*!=\s*nil\s*(?=\{)"
)
LOGS = re.compile(r"\b(?:log|logger|logging|console|Log|fmt\.Print\w*|print|puts|warn|warning|error|info|debug|trace|Console\.WriteLine|System\.out)\b")
CARRIES = re.compile(r"exc_info|\.exception\(|\bstack\w*|stackTrace|\berr\b|\bex\b|\be\)")
NOTHING = re.compile(r"^(?:pass|continue|return(?:\s+(?:None|null|nil|False|false|\[\]|\{\}|\"\"|''))?;?|\.\.\.|;)$")


def swallowed(text: str | None) -> Iterator[tuple[int, str, str | None]]:
    """``(line, body, name)`` of handlers of Python and of languages with braces: empty, pass, return, log, or handled (FUN12, FUN28).

    A body that logs the error itself, or how it came about, handles it.
    """
    lines = (text or "").split("\n")
    for n, line in enumerate(lines):
        m = HANDLER.search(line)
        if not m:
            continue
        if m["py"] is not None:
            tail = line[m.end() :].strip()
            body, name = ([tail] if tail else []) + indented(lines, n)[0], re.search(r"\bas\s+(\w+)", m["py"])
            name = name[1] if name else None
        else:
            at = line.find("{", m.start())
            place = (n, at) if at >= 0 else (n + 1, 0)
            body = braced(lines, *place)[0] if place[0] < len(lines) else []
            words = re.findall(r"[A-Za-z_]\w*", m["brace"] or "")
            name = m["bare"] or m["error"] or (words[-1] if words else None)
        code = [x.strip() for x in body if x.strip() and not x.strip().startswith(("#", "//", "*", "/*"))]
        if not code:
            kind = "empty"
        elif all(map(NOTHING.match, code)):
            kind = "return" if any(x.startswith("return") for x in code) else "pass"
        elif all(map(LOGS.search, code)) and not any(CARRIES.search(x) or (name and re.search(rf"\b{re.escape(name)}\b", x)) for x in code):
            kind = "log"
        else:
            kind = "handled"
        yield n + 1, kind, name


DECLARED = re.compile(
    r"^\s*(?:export\s+)?(?:default\s+)?(?:(?:public|private|protected|internal|static|final|abstract|sealed|async|override)\s+)*"
    r"(?:(?P<kind>class|interface|enum|struct|record)\s+(?P<type>\w+)|function\s*\*?\s*(?P<function>\w+)|type\s+(?P<go>\w+)\s+(?:struct|interface)\b"
    r"|func\s+(?:\(\s*\w*\s*\*?(?P<of>\w+)\s*\)\s*)?(?P<func>\w+)\s*\(|(?:const|let|var)\s+(?P<arrow>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>|(?P<result>[\w<>\[\],.?]+)\s+(?P<method>\w+)\s*\([^;]*$)"
)
NO_RESULT = frozenset("return new else throw await yield case if for while switch catch using lock".split())


def declared(text: str | None) -> Iterator[tuple[str, str, int, int]]:
    """``(name, kind, l0, l1)`` of types, functions and methods in code of languages with braces, by a line grammar (EXT05)."""
    lines = (text or "").split("\n")
    within: list[tuple[str, int]] = []
    for n, line in enumerate(lines):
        while within and within[-1][1] < n:
            within.pop()
        m = DECLARED.match(line)
        if not m or (m["method"] and (m["result"] in NO_RESULT or not within)):
            continue
        at = next(((k, c) for k in range(n, min(n + 3, len(lines))) if (c := lines[k].find("{")) >= 0), None)
        last = braced(lines, *at)[1] if at else n
        name = m["type"] or m["function"] or m["go"] or m["func"] or m["arrow"] or m["method"]
        kind = "class" if m["type"] or m["go"] else "function"
        owner = m["of"] or (within[-1][0] if within and (m["method"] or kind == "class") else "")
        yield f"{owner}.{name}" if owner else name, kind, n + 1, last + 1
        if kind == "class":
            within.append((f"{owner}.{name}" if owner else name, last))


#: What annotations and attributes of other languages limit.
LIMITS = {"Min": "ge", "DecimalMin": "ge", "Max": "le", "DecimalMax": "le", "MinLength": "min_length", "MaxLength": "max_length", "StringLength": "max_length"}
ANNOTATED = re.compile(r"[@\[](Min|Max|DecimalMin|DecimalMax|Size|Range|MinLength|MaxLength|StringLength)\(([^)\n]*)\)")
FIELD = re.compile(r"\b(?:private|protected|public|internal)\s+(?:[\w<>\[\],.?]+\s+)+?(\w+)\s*[;={]")


def limits_of(text: str) -> Iterator[tuple[str, str, int]]:
    """``(field, rule, limit)`` of ``Field(...)`` declarations, bean annotations and data attributes, which may stand on lines above their field."""
    for m in re.finditer(r"(?m)^\s*(\w+)\s*:\s*[^=\n]+=\s*Field\(([^)\n]*)\)", text):
        for rule, raw in re.findall(r"\b(ge|le|gt|lt|min_length|max_length)\s*=\s*(-?[0-9]+)", m[2]):
            yield m[1], rule, int(raw)
    found: list[tuple[str, int]] = []
    for line in text.split("\n"):
        for name, arguments in ANNOTATED.findall(line):
            named = dict(re.findall(r"(\w+)\s*=\s*(-?[0-9]+)", arguments))
            plain = re.findall(r"(?<![\w=.-])-?[0-9]+", re.sub(r"\w+\s*=\s*-?[0-9]+", "", arguments)) or ([named["value"]] if "value" in named else [])
            if name == "Size":
                found += [(r, int(named[k])) for k, r in (("min", "min_length"), ("max", "max_length")) if k in named]
            elif name == "Range" and len(plain) > 1:
                found += [("ge", int(plain[0])), ("le", int(plain[1]))]
            elif name in LIMITS and plain:
                found.append((LIMITS[name], int(plain[0])))
        if found and (m := FIELD.search(line)):
            yield from ((m[1], rule, k) for rule, k in found)
            found = []


def boundaries(text: str | None) -> Iterator[tuple[str, str, str, str]]:
    """``(field, rule, value, expected)`` at and beyond the limits that declarations of three languages set (EXT04)."""
    for name, rule, k in limits_of(text or ""):
        inside, outside = {"ge": (k, k - 1), "le": (k, k + 1), "gt": (k + 1, k), "lt": (k - 1, k), "min_length": (k, k - 1), "max_length": (k, k + 1)}[rule]
        yield name, rule, str(inside), "accept"
        yield name, rule, str(outside), "reject"


def joined_lines(text: str | None, most: int = 200) -> Iterator[tuple[int, int, str]]:
    """``(l0, l1, statement)``: lines joined while brackets are open or a backslash ends them (WIN11, FUN39)."""
    at, depth, part = 0, 0, []
    for n, line in enumerate((text or "").split("\n"), 1):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#.*$", "", line)
        depth = max(0, depth + sum(bare.count(c) for c in "([{") - sum(bare.count(c) for c in ")]}"))
        if not part:
            at = n
        part.append(line.strip().removesuffix("\\").rstrip())
        if (not depth and not line.rstrip().endswith("\\")) or len(part) > most:
            yield at, n, " ".join(x for x in part if x)
            part, depth = [], 0
    if part:
        yield at, at + len(part) - 1, " ".join(x for x in part if x)


def front_matter(text: str | None) -> Iterator[tuple[str, str]]:
    """``(key, value)`` of simple pairs in the front matter between two ``---`` lines (SRC20)."""
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", (text or "").replace("\r\n", "\n"), re.S)
    for line in m[1].split("\n") if m else ():
        if pair := re.match(r"([A-Za-z_][\w-]*):[ \t]*(.*?)[ \t]*$", line):
            yield pair[1], pair[2].strip("\"'")


def md_tables(text: str | None) -> Iterator[tuple[int, int, str, str]]:
    """``(table line, row, column name, cell)`` of the cells of Markdown tables (SRC34)."""
    cells = lambda line: [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]
    for _, kind, at, _, _, body in md_blocks(text):
        if kind == "table":
            head, _, *rest = body.split("\n")
            names = cells(head)
            for n, line in enumerate(rest):
                for name, cell in zip(names, cells(line), strict=False):
                    yield at, n, name, cell


#: Heads of loops, and what to look for in their bodies.
LOOP = re.compile(r"^\s*(?:async\s+for\b|for\b|while\b|foreach\b|.*\.forEach\s*\()")
SMELLS = {
    "io-in-loop": re.compile(r"\b(?:open|subprocess\.(?:run|check_output|call|Popen)|requests\.(?:get|post|put|delete|head)|fetch|axios\.\w+|urlopen)\s*\(|\.(?:query|execute|fetchone|fetchall|find_one|find)\s*\("),
    "regex-in-loop": re.compile(r"\b(?:re\.compile|new\s+RegExp|Pattern\.compile|regexp\.MustCompile|Regex::new)\s*\("),
    "sort-in-loop": re.compile(r"\bsorted\s*\(|\.sort(?:ed|By)?\s*\("),
    "membership-in-loop": re.compile(r"\bin\s*\[|\.includes\s*\(\s*['\"]"),
}


def loop_smells(text: str | None) -> Iterator[tuple[str, int, int]]:
    """``(rule, line, loop line)`` of costly calls in loops of Python and of languages with braces, told once against the outermost loop (FUN29).

    Comments say nothing, and a head of an inner loop is not part of a body.
    """
    lines = (text or "").split("\n")
    n = 0
    while n < len(lines):
        bare = re.sub(r"(?:#|//).*$", "", lines[n]).rstrip()
        last = n
        if LOOP.match(bare):
            if bare.endswith(":"):
                last = indented(lines, n)[1]
            elif "{" in bare:
                last = braced(lines, n, bare.find("{"))[1]
            elif n + 1 < len(lines) and lines[n + 1].lstrip().startswith("{"):
                last = braced(lines, n + 1, 0)[1]
            for at in range(n + 1, last + 1):
                body = re.sub(r"(?:#|//).*$", "", lines[at])
                if not LOOP.match(body):
                    yield from ((rule, at + 1, n + 1) for rule, smell in SMELLS.items() if smell.search(body))
        n = last + 1


#: Client, its call, and the argument that bounds its time.
CLIENTS = [
    ("requests/httpx", r"\b(?:requests|httpx)\.(?:get|post|put|delete|patch|head|request)\(", r"\btimeout\s*="),
    ("fetch", r"\bfetch\(", r"\bsignal\b|\btimeout\b"),
    ("axios", r"\baxios(?:\.\w+)?\(", r"\btimeout\b|\bsignal\b"),
    ("HttpClient", r"new\s+HttpClient\(", r"\bTimeout\b"),
    ("net/http", r"\bhttp\.(?:Get|Post|Head|PostForm)\(", r"\bTimeout\b"),
    ("http.Client", r"&http\.Client\{", r"\bTimeout\b"),
    ("Net::HTTP", r"Net::HTTP", r"read_timeout"),
    ("urlopen", r"\burlopen\(", r"\btimeout\b"),
    ("curl", r"(?<![\w.])curl\b", r"--max-time|(?<!\w)-m\s+\d"),
]
CLIENTS = [(name, re.compile(call), re.compile(bound)) for name, call, bound in CLIENTS]


def no_timeout(text: str | None, most: int = 20) -> Iterator[tuple[int, str]]:
    """``(line, client)`` of calls, at most ``most`` more lines long, of nine clients that set no limit of time (FUN30)."""
    lines = (text or "").split("\n")
    for n, line in enumerate(lines):
        if line.lstrip().startswith(("#", "//", "*")):
            continue
        for name, call, bound in CLIENTS:
            if m := call.search(line):
                span, open_ = line, m[0][-1]
                if open_ in "({":
                    shut, last = {"(": ")", "{": "}"}[open_], n
                    while span.count(open_) > span.count(shut) and last + 1 < len(lines) and last - n < most:
                        last += 1
                        span += " " + lines[last]
                if not bound.search(span):
                    yield n + 1, name


def cli_options(text: str | None) -> Iterator[tuple[str, str | None, list[str], bool | None]]:
    """``(name, default, choices, required)`` of argparse options in Python source; required is null when it is not said (FUN36, FUN37)."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return
    for x in ast.walk(tree):
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr == "add_argument":
            names = [a.value for a in x.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]
            named = {k.arg: k.value for k in x.keywords}
            value = lambda k: named[k].value if isinstance(named.get(k), ast.Constant) else None  # noqa: B023, E731
            choices = [str(e.value) for e in getattr(named.get("choices"), "elts", []) if isinstance(e, ast.Constant)]
            if names:
                default = value("default")
                yield max(names, key=len), None if default is None else str(default), choices, value("required")


LITERAL = re.compile(r"//[^\n]*|--[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)


def masked_lines(text: str | None) -> Iterator[tuple[int, str]]:
    """``(line, code)`` of code with comments and strings blanked, each character by a space, so that columns stay; a null text has none (FUN36)."""
    if text is None:
        return
    blank = LITERAL.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    yield from ((n, x.rstrip()) for n, x in enumerate(blank.split("\n"), 1))


#: Kinds of tokens in code spans, the first that fits.
TOKENS = [
    ("cite", re.compile(r"[\w./-]+\.\w+:[0-9]+(?:-[0-9]+)?$")),
    ("version", re.compile(r"v?[0-9]+(?:\.[0-9]+)+(?:[-+][\w.]+)?$")),
    ("script", re.compile(r"(?:npm run|yarn|pnpm|make|just)\s+[\w:-]+$")),
    ("anchor", re.compile(r"#[\w-]+$")),
    ("path", re.compile(r"(?:\.{0,2}/)?[\w.-]+(?:/[\w.-]+)*/?$")),
]


def token_kind(token: str | None) -> str | None:
    """What a code span or a link target names; null for none and for what has a scheme."""
    if not token or "://" in token:
        return None
    return next((k for k, p in TOKENS if p.match(token) and (k != "path" or "/" in token or "." in token.strip("."))), "name")


def md_tokens(text: str | None) -> Iterator[tuple[int, int, int, str, str]]:
    """``(line, c0, c1, kind, text)`` of citations, versions, scripts, anchors and paths in code spans and link targets (SRC33).

    A path has a slash or an ending; other words are ``name``.
    """
    for at, c0, c1, kind, body, target in md_inlines(text):
        token = body if kind == "code" else target
        if found := token_kind(token):
            yield at, c0, c1, found, token


def _leaves(node: object, prefix: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(node, dict):
        for k, v in node.items():
            yield from _leaves(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(node, list):
        for k, v in enumerate(node):
            yield from _leaves(v, f"{prefix}[{k}]")
    elif node is not None:
        yield prefix, str(node).lower() if isinstance(node, bool) else str(node)


def _nested(text: str) -> Iterator[tuple[str, str]]:
    """Maps by indentation with plain values, which is what settings files have of YAML; lists and anchors are left out."""
    above: list[tuple[int, str]] = []
    for line in text.split("\n"):
        if m := re.match(r"( *)([\w.-]+):(?:[ \t]+(.*?))?[ \t]*$", re.sub(r"(?:^|[ \t])#.*$", "", line)):
            depth = len(m[1])
            while above and above[-1][0] >= depth:
                above.pop()
            above.append((depth, m[2]))
            if m[3]:
                yield ".".join(k for _, k in above), m[3].strip("\"'")


def settings(path: str | None, text: str | None) -> Iterator[tuple[str, str]]:
    """``(key, value)`` of a settings file of six formats, by its ending; nested keys with dots; none where it does not parse (SRC21)."""
    ending = (path or "").rsplit(".", 1)[-1].lower()
    text = text or ""
    try:
        if ending == "json":
            yield from _leaves(json.loads(text))
        elif ending == "toml":
            yield from _leaves(tomllib.loads(text))
        elif ending in ("yml", "yaml"):
            yield from _nested(text)
        elif ending in ("ini", "cfg"):
            c = configparser.ConfigParser(interpolation=None)
            c.optionxform = str
            c.read_string(text)
            yield from ((f"{s}.{k}", v) for s in c.sections() for k, v in c.items(s))
        elif ending in ("properties", "env"):
            for line in text.split("\n"):
                if m := re.match(r"\s*(?:export\s+)?([\w.-]+)\s*[=:]\s*(.*?)\s*$", line):
                    yield m[1], m[2].strip("\"'")
    except (ValueError, configparser.Error, RecursionError):
        return


def md_anchors(text: str | None, tag: str = "finding") -> Iterator[tuple[str, int, str, str]]:
    """``(slug, line, key, value)`` of the pairs in code blocks fenced with ``tag``, under the heading that names them (SRC20).

    The slug is the block's own, else the heading's; a report with a slug twice is for its reader to refuse.
    """
    above = ""
    for _, kind, l0, l1, _, body in md_blocks(text):
        if kind.startswith("heading"):
            above = re.sub(r"[^a-z0-9]+", "-", body.lower()).strip("-")
        elif kind == "code" and re.match(rf" {{0,3}}(?:`{{3,}}|~{{3,}})[ \t]*{tag}\b", (text or "").replace("\r\n", "\n").split("\n")[l0 - 1]):
            pairs = [(m[1], m[2].strip("\"'")) for x in body.split("\n") if (m := re.match(r"([A-Za-z_][\w-]*):[ \t]*(.*?)[ \t]*$", x))]
            slug = next((v for k, v in pairs if k == "slug"), above)
            yield from ((slug, l0, k, v) for k, v in pairs if k != "slug")


def md_structure(text: str | None) -> Iterator[tuple]:
    from millrace.functions import markdown

    return markdown.md_structure(text)


def md_spans(text: str | None) -> Iterator[tuple]:
    from millrace.functions import markdown

    return markdown.md_spans(text)


def comment_spans(language: str | None, text: str | None = None) -> Iterator[tuple]:
    from millrace.functions import code

    return code.comment_spans(language, text)


def sql_definitions(text: str | None) -> Iterator[tuple]:
    from millrace.functions import code

    return code.sql_definitions(text)


#: EXT01: the table functions with their schemas.
FUNCTIONS = {
    "md_blocks": (md_blocks, "idx int, kind string, l0 int, l1 int, parent int, text string"),
    "md_inlines": (md_inlines, "line int, c0 int, c1 int, kind string, text string, target string"),
    "md_structure": (md_structure, "idx int, kind string, l0 int, l1 int, parent int, level int, info string, closed boolean, list_id int, text string"),
    "md_spans": (md_spans, "block int, cell int, kind string, l0 int, c0 int, l1 int, c1 int, o_l0 int, o_c0 int, o_l1 int, o_c1 int, text string, label string"),
    "comment_spans": (comment_spans, "line int, c0 int, c1 int, kind string, text string"),
    "sql_definitions": (sql_definitions, "name string, kind string, owner string, l0 int, l1 int"),
    "gherkin_blocks": (gherkin_blocks, "kind string, name string, tags array<string>, line int, body string"),
    "python_definitions": (python_definitions, "name string, kind string, l0 int, l1 int"),
    "declared": (declared, "name string, kind string, l0 int, l1 int"),
    "no_timeout": (no_timeout, "line int, client string"),
    "md_anchors": (md_anchors, "slug string, line int, key string, value string"),
    "masked_lines": (masked_lines, "line int, code string"),
    "md_tokens": (md_tokens, "line int, c0 int, c1 int, kind string, text string"),
    "swallowed": (swallowed, "line int, body string, name string"),
    "boundaries": (boundaries, "field string, rule string, value string, expected string"),
    "front_matter": (front_matter, "key string, value string"),
    "md_tables": (md_tables, "at int, row int, name string, cell string"),
    "loop_smells": (loop_smells, "rule string, line int, loop int"),
    "cli_options": (cli_options, "name string, default string, choices array<string>, required boolean"),
    "joined_lines": (joined_lines, "l0 int, l1 int, statement string"),
}


def _gathered(rows: Iterator[tuple], most: int = 4096) -> Iterator[list[tuple]]:
    """Lists of at most ``most`` rows, so that a worker holds few rows at a time however many texts a batch has."""
    while part := list(islice(rows, most)):
        yield part


def register(spark: SparkSession) -> None:
    """Make every table function callable from SQL, as in ``FROM docs, LATERAL md_blocks(text)``."""
    from pyspark.sql.functions import udtf

    ship(spark)

    def wrapped(f):
        class Handler:
            def eval(self, *texts: str):
                yield from f(*texts)

        return Handler

    for name, (f, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(wrapped(f), returnType=schema))


def read_settings(files: DataFrame) -> DataFrame:
    """``source, key, value`` of settings files ``(path, text)``, the path as source (SRC21)."""
    import pandas as pd

    ship(files.sparkSession)

    def run(batches):
        for p in batches:
            for rows in _gathered((path, *r) for path, t in p.itertuples(index=False) for r in settings(path, t)):
                yield pd.DataFrame(rows, columns=["source", "key", "value"]).astype(object)

    return files.select("path", "text").mapInPandas(run, "source string, key string, value string")


def apply(df: DataFrame, function: str, text: str | list[str], keep: list[str]) -> DataFrame:
    """Rows of a table function for each text, or for what it takes besides, with the columns to keep; Arrow batches, no shuffle."""
    import pandas as pd

    ship(df.sparkSession)
    f, schema = FUNCTIONS[function]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds, taken, n = dict(df.dtypes), [text] if isinstance(text, str) else text, len(keep)

    def run(batches):
        for p in batches:
            for rows in _gathered((*x[:n], *r) for x in p.itertuples(index=False, name=None) for r in f(*x[n:])):
                yield pd.DataFrame(rows, columns=keep + names).astype(object)

    return df.select(*keep, *[F.col(c).alias(f"_text{i}") for i, c in enumerate(taken)]).mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), schema]))
