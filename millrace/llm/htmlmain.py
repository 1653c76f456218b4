"""Main text of HTML pages, with a suffix array of each host's repeated runs.

A page is read into blocks, each in a zone: ``article`` (inside such an element), ``main``
(inside what is marked as the main part), ``fixed`` (elements and roles that never hold main
text: menus, headers, footers, asides, forms, hidden parts), ``named`` (elements that a class or id
calls an advert, a notice, a comment and so on) or ``open`` (none of these).

Every page's text outside its articles goes into its host's array, one stream for each part
of a zone; equal streams of a host count once, with the smallest and largest of their
pages. Suffixes, as ids of their first ``PREFIX`` tokens, are dealt by host and first
``RUN`` tokens and sorted; where the common prefix of neighbours is ``RUN`` or more they are one
interval, and an interval with suffixes of two different pages is a repeated run. Dealing by the first
``RUN`` tokens cuts the array only where common prefixes are shorter, so no interval is lost, and
copies of a suffix are one row before they are dealt, so that no passage is a group of its own.

A block whose tokens runs cover whole is boilerplate. Text inside an article, or on a page
without any inside the marked main part, is protected: articles share licence lines and
passages, and those stay. Of the rest, blocks of a main part beside articles and, on pages
without either, ``open`` blocks stay if runs do not cover them whole, so prose that only shares
phrases is kept. ``named`` blocks that runs leave go by their names, as adverts and comments
also come once.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import flat_map_rows
from millrace.session import cut, ship

#: Tokens of the shortest run, and of a suffix as far as it is sorted.
RUN, PREFIX = 6, 12
#: Covered runs are broadcast up to so many numbers (16 bytes each, and 50 for each stream), beyond that joined by page.
BROADCAST_RUNS = 500_000
#: Suffixes that a task emits at a time.
EMIT = 16_384
#: Elements by role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg".split())
CHROME = frozenset("nav footer aside form menu button select option label dialog head object canvas audio video map datalist".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist reply replies disqus "
    "respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay paywall widget widgets "
    "pagination pager skip search copyright disclaimer".split()
)
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
#: An element inside another says more of a zone only if it is stronger.
STRENGTH = {"": 0, "asked": 1, "named": 2, "fixed": 3}
#: Of these, the ones that an article element of its own is set aside by.
ASIDE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())
#: Names of a main part.
MAIN = frozenset("main content maincontent article-body articlebody article-content post-content post-body entry-content story-body page-content".split())
#: An opening tag of a key ends an open element of its values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def chrome_zone(name: str, attributes: str, inside_main: bool) -> str | None:
    """``fixed``; ``named`` where a class or id is one of the names; ``asked`` where one has a name as a part, as in
    ``search-results`` and ``copyright-law``, so that only the array can tell; or none of these."""
    if name in CHROME or (name == "header" and not inside_main):
        return "fixed"
    if not attributes or name in ("html", "body", "main"):
        return None
    names, zone = ASIDE if name == "article" else NAMES, None
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            is_name = lambda w: w in names and not (inside_main and w == "header")
            if any(map(is_name, value.split())):
                zone = "named"
            elif zone is None and any(map(is_name, re.split(r"[^a-z]+", value))):
                zone = "asked"
        if key == "hidden" or (key == "role" and value in ROLES) or (key == "aria-hidden" and value == "true"):
            return "fixed"
        if key == "style" and "display:none" in value.replace(" ", ""):
            return "fixed"
    return zone


def is_main(name: str, attributes: str) -> bool:
    if name == "main":
        return True
    if not attributes or name in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if (key in ("class", "id") and not MAIN.isdisjoint(value.split())) or (key, value) in (("role", "main"), ("itemprop", "articlebody")):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, str, int]]:
    """``(zone, text, part)`` of the page's blocks in order; text decoded, white space single.

    ``part`` numbers the stretches of a page that lie in one zone and, if it is ``fixed``, ``named`` or asked about, in one such element.
    The zone of a block that is asked about is that around it with a question mark.
    """
    page = page or ""
    out: list[tuple[str, str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int, str, int]] = []  # name; article and main depth, chrome zone and its number outside it
    last_blocks: list[int] = []  # places in the stack of elements that an opening tag may end
    opened: Counter[str] = Counter()
    article = main = number = chrome_number = at = 0
    chrome, before, part = "", None, -1

    def flush() -> None:
        nonlocal before, part
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                zone = "article" if article else "main" if main else "open"
                zone = f"{zone}?" if chrome == "asked" else chrome or zone
                part += (zone, chrome_number) != before
                before = (zone, chrome_number)
                out.append((zone, text, part))
            parts.clear()

    def close(n: int) -> None:
        nonlocal article, main, chrome, chrome_number
        _, article, main, chrome, chrome_number = stack[n]
        for name, *_ in stack[n:]:
            opened[name] -= 1
        del stack[n:]
        while last_blocks and last_blocks[-1] >= n:
            last_blocks.pop()

    while True:
        m = MARKUP.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in RAW and not m[1]:
            end = ENDS[name].search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            if opened[name]:  # each element that is passed here is closed, so this is no search of the whole stack again and again
                n = len(stack) - 1
                while stack[n][0] != name:
                    n -= 1
                flush()
                close(n)
            continue
        if name in VOID:
            continue
        ended = {"p"} if name in BLOCKS else set()
        ended |= CLOSES.get(name, set())
        if last_blocks and stack[last_blocks[-1]][0] in ended:
            close(last_blocks[-1])
        new_chrome, new_main = chrome_zone(name, m[3], article + main > 0), is_main(name, m[3])
        if new_chrome or new_main or name == "article":
            flush()
        if name in BLOCKS or name == "option":
            last_blocks.append(len(stack))
        stack.append((name, article, main, chrome, chrome_number))
        opened[name] += 1
        article += name == "article"
        main += new_main
        if new_chrome and STRENGTH[new_chrome] > STRENGTH[chrome]:
            number += 1
            chrome, chrome_number = new_chrome, number
    flush()
    return out


def protected(found: list[tuple[str, str, int]]) -> str:
    """The zone whose text stays whatever other pages repeat; none on a page without articles and main part."""
    zones = {z.removesuffix("?") for z, *_ in found}
    return "article" if "article" in zones else "main" if "main" in zones else ""


def judged(found: list[tuple[str, str, int]]) -> str:
    """The zone whose blocks stay unless repeated runs cover them: a main part beside articles, open blocks of a page without either."""
    return {"article": "main", "main": "", "": "open"}[protected(found)]


def main_text(found: list[tuple[str, str, int]], boilerplate: set[int] | None = None) -> str:
    """The page's main text in page order; ``boilerplate`` has the numbers of blocks that repeated runs cover. None: protected text alone.

    What is asked about in these zones stays unless it is covered. A page on which nothing is protected and no block of ``RUN`` tokens would stay is a
    mirror of another: its covered blocks of so many tokens are no boilerplate and stay.
    """
    safe, open_ = protected(found), judged(found)
    asked = {z for z in (safe and safe + "?", open_, open_ and open_ + "?") if z}
    stays = {k for k, (z, _, _) in enumerate(found) if z == safe}
    if boilerplate is not None:
        stays |= {k for k, (z, _, _) in enumerate(found) if z in asked and k not in boilerplate}
        long = {k for k, (z, t, _) in enumerate(found) if z in asked and t.count(" ") + 1 >= RUN}
        if not safe and stays.isdisjoint(long):
            stays |= long
    return "\n\n".join(t for k, (_, t, _) in enumerate(found) if k in stays)


def host(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def streams(found: list[tuple[str, str, int]]) -> list[tuple[int, list[str]]]:
    """``(number of the first block, texts)`` of the page's parts outside the protected zone."""
    safe, out, last = protected(found), [], None
    for k, (zone, text, part) in enumerate(found):
        if zone != safe:
            if part != last:
                out.append((k, []))
                last = part
            out[-1][1].append(text)
    return out


def digest(*values: object) -> bytes:
    return xxhash.xxh3_128_digest(repr(values).encode("utf-8", "surrogatepass"))


def stream_key(url: str | None, texts: list[str]) -> bytes:
    return digest(host(url), texts)


def token_ids(stream: str) -> np.ndarray:
    """A 32-bit id of each token; a run of ``RUN`` equal ids is taken for equal tokens."""
    return np.array([xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in stream.split(" ")], ">u4")


def suffixes(distinct: DataFrame) -> DataFrame:
    """``host, prefix, stream, at, low, high``: each suffix of ``RUN`` tokens or more of ``distinct(host, stream, text, low, high)``, as ids."""
    ship(distinct.sparkSession)
    binary, wide = pa.binary(), 4 * PREFIX
    schema = pa.schema([("host", pa.int64()), ("prefix", binary), ("stream", binary), ("at", pa.int32()), ("low", binary), ("high", binary)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h, key, text, low, high = (c[row].as_py() for c in batch.columns)
                ids = np.append(token_ids(text), np.zeros(PREFIX, ">u4"))
                raw, most = ids.tobytes(), len(ids) - PREFIX
                for start in range(0, most - RUN + 1, EMIT):
                    at = range(start, min(most - RUN + 1, start + EMIT))
                    n = len(at)
                    # a suffix shorter than PREFIX ends with its tokens
                    prefix = [raw[4 * k : min(4 * k + wide, 4 * most)] for k in at]
                    columns = ([h] * n, prefix, [key] * n, list(at), [low] * n, [high] * n)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return distinct.select("host", "stream", "text", "low", "high").mapInArrow(emit, "host long, prefix binary, stream binary, at int, low binary, high binary")


def common_prefix(a: bytes, b: bytes) -> int:
    """Tokens that two prefixes begin with alike."""
    if a == b:
        return len(a) // 4
    return next((k // 4 for k in range(0, min(len(a), len(b)), 4) if a[k : k + 4] != b[k : k + 4]), min(len(a), len(b)) // 4)


def intervals(array: DataFrame) -> DataFrame:
    """``host, run, longest``: runs of suffixes in ``array(host, prefix, low, high)`` that stand on two different pages, and their longest common prefix.

    Rows are dealt by host and first ``RUN`` tokens and sorted; one pass over neighbours
    keeps the open interval's smallest and largest page only.
    """
    ship(array.sparkSession)
    run = F.substring("prefix", 1, 4 * RUN)
    parts = int(array.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = array.withColumn("run", run).repartition(parts, "host", "run").sortWithinPartitions("host", "prefix").select("host", "prefix", "low", "high")
    schema = pa.schema([("host", pa.int64()), ("run", pa.binary()), ("longest", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, low, high, longest, out = None, b"", b"", 0, []

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for h, prefix, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                common = common_prefix(before[1], prefix) if before and before[0] == h else 0
                if common >= RUN:
                    low, high, longest = min(low, a), max(high, b), max(longest, common)
                else:
                    if before and low < high:
                        out.append((before[0], before[1][: 4 * RUN], longest))
                    low, high, longest = a, b, len(prefix) // 4 if a < b else 0
                longest = max(longest, len(prefix) // 4 if a < b else 0)
                before = (h, prefix)
            if out:
                yield flush(out)
                out = []
        if before and low < high:
            yield flush([(before[0], before[1][: 4 * RUN], longest)])

    return ordered.mapInArrow(scan, "host long, run binary, longest int")


def repeated_runs(pages: DataFrame) -> DataFrame:
    """``stream, covered``: streams with tokens that runs on two pages of their host cover; ``covered`` has the runs' first tokens.

    A stream of fewer than ``RUN`` tokens is a run if another page of the host has it: ``covered`` is then ``[0]``.
    """

    def make():
        def one(i, url, page):
            found, key, h = blocks(page), digest(i, url, page), host(url)
            number = xxhash.xxh64_intdigest(h.encode("utf-8", "surrogatepass")) - (1 << 63)
            return [(number, digest(h, texts), " ".join(texts), key) for _, texts in streams(found)]

        return one

    every = flat_map_rows(pages, make, "host long, stream binary, text string, page binary")
    # equal streams of a host count once, with the smallest and largest of their pages
    distinct = cut(every.groupBy("host", "stream", "text").agg(F.min("page").alias("low"), F.max("page").alias("high")))
    long = suffixes(distinct)
    array = long.groupBy("host", "prefix").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    runs = intervals(array).select("host", "run")
    hit = long.withColumn("run", F.substring("prefix", 1, 4 * RUN)).join(runs, ["host", "run"], "left_semi")
    covered = hit.groupBy("stream").agg(F.sort_array(F.collect_list("at")).alias("covered"))
    short = distinct.where(F.size(F.split("text", " ")) < RUN).where("low < high").select("stream", F.array(F.lit(0)).alias("covered"))
    return covered.union(short)


def covered_blocks(texts: list[str], starts: list[int]) -> tuple[list[bool], int]:
    """Which of a stream's blocks runs cover whole, and the number of tokens that they cover."""
    sizes = np.array([t.count(" ") + 1 for t in texts])
    mark = np.zeros(int(sizes.sum()) + 1, np.int64)
    at = np.asarray(starts, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, np.minimum(at + RUN, len(mark) - 1), -1)
    inside = np.cumsum(mark[:-1]) > 0
    return [bool(x) for x in np.logical_and.reduceat(inside, np.cumsum(sizes) - sizes)], int(inside.sum())


def extracted(page: str | None, url: str | None, get: Callable[[bytes], list[int] | None]) -> tuple[str, int]:
    """The main text, and the tokens outside it that runs cover; ``get`` gives a stream's ``covered``."""
    found = blocks(page)
    boilerplate, n = set(), 0
    for first, texts in streams(found):
        starts = get(stream_key(url, texts))
        if starts is not None:
            whole, tokens = covered_blocks(texts, starts)
            boilerplate |= {first + k for k, x in enumerate(whole) if x}
            n += tokens
    return main_text(found, boilerplate), n


def extract(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars, n_repeated`` (tokens outside the protected text that repeated runs cover).

    Null or empty html gives an empty text. Null ids, null URLs (host: empty) and
    repeated rows are handled like any other; equal rows are one page to the
    array. Extra columns are ignored. Pages are read once for the array and once for their text, which
    is never shuffled while the runs are few enough to broadcast (``most`` numbers); beyond that pages are joined with their runs.
    """
    spark = pages.sparkSession
    own = pages.select("page_id", "url", "html")
    runs = cut(repeated_runs(own))
    size = runs.agg(F.count("*").alias("n"), F.sum(F.size("covered").cast("long")).alias("numbers")).first()
    schema = "page_id long, url string, text string, n_chars long, n_repeated long"
    if size.n + (size.numbers or 0) <= (BROADCAST_RUNS if most is None else most):
        known = spark.sparkContext.broadcast({bytes(r.stream): np.array(r.covered, np.int32) for r in runs.toLocalIterator()})

        def one_pass():
            get = known.value.get

            def one(i, url, page):
                text, n = extracted(page, url, get)
                return [(i, url, text, len(text), n)]

            return one

        return flat_map_rows(own, one_pass, schema)

    def keyed():
        return lambda i, url, page: [(digest(i, url, page), stream_key(url, texts)) for _, texts in streams(blocks(page))]

    wanted = flat_map_rows(own, keyed, "page binary, stream binary").distinct().join(runs, "stream")
    by_page = wanted.groupBy("page").agg(F.collect_list(F.struct("stream", "covered")).alias("runs")).withColumnRenamed("page", "_page")

    def with_key():
        return lambda i, url, page: [(i, url, page, digest(i, url, page))]

    both = flat_map_rows(own, with_key, "page_id long, url string, html string, page binary").join(by_page, F.col("page") == F.col("_page"), "left")

    def joined():
        def one(i, url, page, found):
            text, n = extracted(page, url, {bytes(r["stream"]): r["covered"] for r in found or ()}.get)
            return [(i, url, text, len(text), n)]

        return one

    return flat_map_rows(both.select("page_id", "url", "html", "runs"), joined, schema)
