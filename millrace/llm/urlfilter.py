"""URL filters: host-suffix and path-prefix expressions, hash prefixes, full digests.

A URL's host gives those of its suffixes at label boundaries that have as many labels as
some rule's host, its path those prefixes that are as long as some rule's path: what a URL
is expanded into is bounded by the rules, however many labels or slashes it has. The
digests' first ``PREFIX`` hex digits are joined with the rules', the full digests
confirmed, and the longest rule wins. All in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = 8
#: Rule tables up to this many rows are broadcast (their rows have under 300 bytes), larger ones are joined by shuffle.
BROADCAST_RULES = 100_000
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def parts(url: str | Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or a URL without ``://``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_table(spark: SparkSession, rules=RULES) -> tuple[DataFrame, list[int], list[int]]:
    """``prefix, digest, rule, verdict, n_host, n_path``; the numbers of labels of hosts; the lengths of paths.

    Of rules for one host and path the last counts.
    """
    last = {(h, p): v for h, p, v in rules}
    rows = [(h + p, h, p, v, len(h), len(p)) for (h, p), v in last.items()]
    frame = spark.createDataFrame(rows, "rule string, h string, p string, verdict string, n_host int, n_path int")
    digest = F.sha2(F.concat_ws("\n", "h", "p"), 256)
    frame = frame.select(F.substr(digest, F.lit(1), F.lit(PREFIX)).alias("prefix"), digest.alias("digest"), "rule", "verdict", "n_host", "n_path")
    return (F.broadcast(frame) if len(rows) <= BROADCAST_RULES else frame), sorted({h.count(".") + 1 for h, _ in last}), sorted({len(p) for _, p in last})


def judge(pages: DataFrame, rules=RULES, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict``.

    The longest fitting rule wins: longest host, then longest path. No rule: null and
    ``default``. Null and malformed URLs have empty host and path and fit nothing. Repeated
    rows are each judged; extra columns are ignored. An empty rule list judges all by default.
    URLs of any length are judged whole.
    """
    host, path = parts(F.col(url))
    own = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    table, labels, lengths = rule_table(pages.sparkSession, rules)
    # each different host and path is expanded and judged once
    seen = own.where("host <> ''").select("host", "path").distinct()
    n_labels = F.length("host") - F.length(F.translate("host", ".", "")) + 1
    some = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    suffixes = some([F.when(n_labels >= n, F.substring_index("host", ".", -n)) for n in labels])
    prefixes = some([F.when(F.length("path") >= n, F.substr("path", F.lit(1), F.lit(n))) for n in lengths])
    expressions = seen.select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("ps")).select("host", "path", "h", F.explode("ps").alias("p"))
    own_digest = F.sha2(F.concat_ws("\n", "h", "p"), 256)
    found = expressions.select("host", "path", own_digest.alias("full")).withColumn("prefix", F.substr("full", F.lit(1), F.lit(PREFIX))).join(table, "prefix").where("full = digest")
    best = found.groupBy("host", "path").agg(F.max(F.struct("n_host", "n_path", "rule", "verdict")).alias("best"))
    b = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "best.rule", "best.verdict")
    return own.join(b, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def oracle(rules=RULES, default: str = "allow") -> str:
    """The same as one CASE over the rules, longest first."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), -len(r[1])))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda get, other: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{get(h, p, v)}'" for h, p, v in ordered) + f" ELSE {other} END"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, rest FROM r),
t AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw_host) + 1), '^([^?#]*)', 1) AS path FROM s)
SELECT page_id, host, path, {case(lambda h, p, v: h + p, 'NULL')} AS rule, {case(lambda h, p, v: v, f"'{default}'")} AS verdict FROM t"""
