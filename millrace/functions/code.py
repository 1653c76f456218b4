"""Comments of one source text as its language has them, and definitions in SQL by statements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

#: Marks of line comments, and of block comments with their ends, by language; the last line is for any other.
COMMENTS: dict[str, tuple[tuple[str, ...], tuple[tuple[str, str], ...]]] = {
    "python": (("#",), ()),
    "ruby": (("#",), ()),
    "php": (("//", "#"), (("/*", "*/"),)),
    "markdown": ((), (("<!--", "-->"),)),
    **dict.fromkeys(("csharp", "java", "kotlin", "typescript", "javascript", "go", "rust", "swift", "cpp", "c"), (("//",), (("/*", "*/"),))),
    "": (("#", "//", "--"), (("/*", "*/"), ("<!--", "-->"))),
}
#: What strings begin and end with, longer marks first; ``STRETCHED`` ones may go on over line ends.
STRINGS = {"python": ('"""', "'''", '"', "'"), "java": ('"""', '"', "'"), "kotlin": ('"""', '"', "'"), "go": ("`", '"', "'"), "javascript": ("`", '"', "'"), "typescript": ("`", '"', "'"), "rust": ('"',), "markdown": ()}
STRETCHED = ('"""', "'''", "`")


@lru_cache(maxsize=64)
def _lexer(language: str) -> re.Pattern[str]:
    marks, blocks = COMMENTS.get(language, COMMENTS[""])
    parts = []
    for quote in STRINGS.get(language, ('"', "'")):
        q, more = re.escape(quote), "" if quote in STRETCHED else r"\n"
        inner = rf"(?:\\.|(?!{q})[^\\{more}])*"
        # a quote after a letter is an apostrophe unless the letters are a prefix; a short string ends on its line
        parts.append(rf"(?:(?<!\w)[rbfuRBFU]{{1,2}}|(?<!\w)){q}{inner}{q}")
    for i, (begin, end) in enumerate(blocks):
        parts.append(rf"(?P<open{i}>{re.escape(begin)})(?P<block{i}>.*?)(?:{re.escape(end)}|\Z)")
    parts += [rf"(?P<mark{i}>{re.escape(m)})(?P<line{i}>[^\n]*)" for i, m in enumerate(marks)]
    return re.compile("|".join(parts), re.S) if parts else re.compile(r"(?!)")


def comment_spans(language: str | None, text: str | None) -> Iterator[tuple[int, int, int, str, str]]:
    """``(line, c0, c1, kind, text)`` of each line of each comment, without marks; kind ``line`` or ``block`` (FUN11).

    Marks in strings begin no comment and quotes in comments no string. A block without an end goes on to the last line; blank lines of blocks give none.
    """
    text = text or ""
    line, start, at = 1, 0, 0
    for m in _lexer((language or "").lower()).finditer(text):
        group = next((k for k, v in m.groupdict().items() if v is not None and k[:4] in ("bloc", "line")), None)
        if group is None:
            continue
        line += text.count("\n", at, m.start(group))
        at = m.start(group)
        start = text.rfind("\n", 0, at) + 1
        column = at - start
        for k, part in enumerate(m[group].split("\n")):
            body = part.strip()
            if group[:5] == "block":
                body = body.lstrip("*").strip()
            if body or group[:4] == "line":
                shift = part.find(body) if body else 0
                yield line + k, (column if not k else 0) + shift, (column if not k else 0) + shift + len(body), "block" if group[:5] == "block" else "line", body


SQL_TOKEN = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:''|[^'])*'?|\$(?P<tag>\w*)\$.*?(?:\$(?P=tag)\$|\Z)|\"[^\"]*\"|`[^`]*`|\[[^\]\n]*\]|[A-Za-z_]\w*|[();,]|[^\s\w]|\w+", re.S)
#: Words that begin an element of a table which is no column.
NO_COLUMN = frozenset("PRIMARY FOREIGN CONSTRAINT UNIQUE CHECK KEY INDEX".split())
OBJECTS = frozenset("TABLE VIEW INDEX TRIGGER".split())
BEFORE_OBJECT = frozenset("OR REPLACE TEMP TEMPORARY UNIQUE VIRTUAL".split())


def sql_definitions(text: str | None, most: int = 30) -> Iterator[tuple[str, str, str | None, int, int]]:
    """``(name, kind, owner, l0, l1)`` of tables, views, indexes, triggers (``sql``) and of columns (``sqlcol``) in SQL (EXT05).

    Statements end at a semicolon outside strings, dollar quotes, comments and ``BEGIN``/``CASE`` to ``END``; one is told as at most ``most`` lines
    long. Columns are the elements of a table's list and those that ``ALTER TABLE`` adds; their owner is the table's name in lower case.
    """
    text = text or ""
    line, at = 1, 0
    said: list[tuple[str, int]] = []
    depth = 0
    for m in SQL_TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        word = m[0]
        if word.startswith(("--", "/*")):
            continue
        upper = word.upper()
        depth = max(0, depth + (upper in ("BEGIN", "CASE")) - (upper == "END"))
        if word == ";" and not depth:
            yield from _statement(said, line, most)
            said = []
        else:
            said.append((word, line))
    if said:
        yield from _statement(said, line + text[at:].rstrip().count("\n"), most)


def _name(tokens: list[tuple[str, int]], at: int) -> tuple[str, int]:
    """A name with dots in front and the place after it; quotes go."""
    parts = [tokens[at][0]]
    while at + 2 < len(tokens) and tokens[at + 1][0] == ".":
        at += 2
        parts.append(tokens[at][0])
    return ".".join(p.strip('"`[]') for p in parts), at + 1


def _statement(tokens: list[tuple[str, int]], end: int, most: int) -> Iterator[tuple[str, str, str | None, int, int]]:
    words = [w.upper() for w, _ in tokens]
    if words[:1] == ["CREATE"]:
        k = 1
        while k < len(words) and words[k] in BEFORE_OBJECT:
            k += 1
        kind = words[k] if k < len(words) and words[k] in OBJECTS else None
        k += 1 + 3 * (words[k + 1 : k + 4] == ["IF", "NOT", "EXISTS"])
        if kind and k < len(tokens):
            first = tokens[0][1]
            name, k = _name(tokens, k)
            yield name, "sql", None, first, min(end, first + most - 1)
            if kind == "TABLE" and words[k : k + 1] == ["("]:
                depth, fresh = 0, True
                for j in range(k, len(tokens)):
                    depth += (words[j] == "(") - (words[j] == ")")
                    if not depth:
                        break
                    if fresh and j > k and depth == 1 and words[j] != "," and j + 1 < len(tokens):
                        if words[j] not in NO_COLUMN and words[j + 1] not in (",", ")", "("):
                            yield tokens[j][0].strip('"`[]'), "sqlcol", name.lower(), tokens[j][1], tokens[j][1]
                        fresh = False
                    fresh = fresh or (words[j] == "," and depth == 1)
    elif words[:2] == ["ALTER", "TABLE"] and len(words) > 2:
        name, k = _name(tokens, 2)
        if words[k : k + 2] == ["ADD", "COLUMN"] and k + 2 < len(tokens):
            yield tokens[k + 2][0].strip('"`[]'), "sqlcol", name.lower(), tokens[k][1], tokens[k][1]
