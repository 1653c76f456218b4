"""Secret scans: fixed patterns, and Shannon entropy in windows that slide over candidate strings.

Spans are in code points, end exclusive. ``base`` spans come from the three patterns;
``entropy`` spans are parts of candidate strings (runs of one token alphabet, cut where base
spans begin and end) in which some window has an entropy over the threshold of the window's
own character class. Parts inside base spans are judged as well: an entropy span there says
which string of a match is random and where it lies. The entropy and class of successive
windows are kept by incremental counts: one symbol leaves, one enters.
Allow-listed strings (digests with a known prefix, UUIDs, versions, paths, words in ordinary
or camel case, access ids, which are names) are suppressed. Null texts are empty; a text of any length is scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16
KINDS = ("assign", "access", "hex", "entropy")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Candidate strings: 16 or more characters of the token alphabet; windows are of 20 characters, or the whole of a shorter part.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST, WINDOW = 16, 20
#: Different characters that a class has, as far as they count in a window, and the share of the most bits a character that a window must reach.
ALPHABET = {"hex": 16, "letters": 52, "alnum": 62, "base64": 64}
THRESHOLD = {"hex": 0.75, "letters": 0.9, "alnum": 0.833, "base64": 0.88}
#: Allow list: whole candidates of these forms, and whole parts between base spans, are no secrets.
ALLOW = [
    re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),  # UUID
    re.compile(r"[0-9]+([-_/=+][0-9]+)*"),  # numbers, dates
    re.compile(r"[-_/=+]*((([A-Z]?[a-z]+)|[A-Z]+)[-_/=+]+)*(([A-Z]?[a-z]+)|[A-Z]+)?[0-9]{0,4}"),  # words, slugs and paths, a short number at the end
    re.compile(r"[A-Z]?[a-z]{2,}([A-Z][a-z]{2,})+[0-9]{0,4}"),  # camel case
    re.compile(r"(sha1|sha256|sha384|sha512|md5)[-_=/][A-Za-z0-9+/=]+"),  # named digests
    ACCESS,  # the name of a key, not the key
    re.compile(r"(.)\1+"),  # one character
]


#: What a character is to a window's class: digit, a-f, A-F, another letter, a sign.
SORT = {c: n for n, cs in enumerate(("0123456789", "abcdef", "ABCDEF", "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", "+/_=-")) for c in cs}


def windows(s: str, width: int = WINDOW) -> Iterator[tuple[float, str]]:
    """Shannon entropy (bits a character) and class of each ``width``-character window of ``s``."""
    width = min(width, len(s))
    if not width:
        return
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    sorts = [0] * 5
    total = 0.0  # the sum of c log c over the counts
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        sorts[SORT.get(ch, 4)] += 1
        if i >= width:
            out = s[i - width]
            c = counts[out]
            total += term[c - 1] - term[c]
            counts[out] = c - 1
            sorts[SORT.get(out, 4)] -= 1
        if i >= width - 1:
            digit, low, high, letter, sign = sorts
            kind = "base64" if sign else "hex" if not letter and not (low and high) else "alnum" if digit else "letters"
            yield math.log2(width) - total / width, kind


def window_entropy(s: str, width: int = WINDOW) -> float:
    """The largest Shannon entropy (bits a character) of any ``width``-character window of ``s``."""
    return max((e for e, _ in windows(s, width)), default=0.0)


def is_random(s: str) -> bool:
    """Whether some window reaches its class's share of the most that its width and alphabet allow."""
    most = {k: THRESHOLD[k] * math.log2(min(WINDOW, len(s), n)) for k, n in ALPHABET.items()}
    return any(e >= most[k] for e, k in windows(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the three patterns."""
    found = []
    low = text.lower().encode("utf-8", "surrogatepass")
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts of candidates, inside and between base spans, of ``LEAST`` characters or more and of high entropy; ``base`` is sorted."""
    found, first = [], 0
    allowed = lambda s: any(p.fullmatch(s) for p in ALLOW)
    for m in CANDIDATE.finditer(text):
        if allowed(m[0]):
            continue
        at, end = m.span()
        while first < len(base) and base[first][2] <= at:
            first += 1
        k, marks = first, {at, end}
        while k < len(base) and base[k][0] < end:
            marks |= {x for x in (base[k][0], base[k][2]) if at < x < end}
            k += 1
        marks = sorted(marks)
        found += [(a, 3, b) for a, b in zip(marks, marks[1:]) if b - a >= LEAST and not allowed(s := text[a:b]) and is_random(s)]
    return found


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``; no shuffle.

    Null or empty text: no spans and the digest of the empty string. Null keys and
    repeated rows are kept as they are; extra columns are ignored.
    """

    def make():
        def one(i, t):
            base, every = scan(t)
            n = [sum(k == x for _, k, _ in base) for x in range(3)]
            return (i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))

        return one

    return map_rows(
        docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones merged, replaced by ``mark``."""
    if not text:
        return text
    out, at, limit = [], 0, 0
    for a, _, b in scan(text)[1]:
        if a >= limit:
            out += [text[at:a], mark]
        limit = at = max(limit, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars`` counted anew; all columns and rows stay.

    Null and empty texts stay as they are, texts of any length are scanned whole, rows that repeat change alike.
    """
    fields = docs.schema
    names = docs.columns
    at_text, at_n = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def make():
        def one(*row):
            row = list(row)
            new = redact(row[at_text])
            if new != row[at_text]:
                row[at_text] = new
                if at_n is not None:
                    row[at_n] = len(new)
            return tuple(row)

        return one

    return map_rows(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
