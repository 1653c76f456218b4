"""Findings queries: evidence, corroboration, quotes, coupling of names, migration of keys, funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import aggregates, findings, joins, linescan, windows
from millrace.plans.registry import query
from millrace.sources.tables import table


def words(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "))).alias("w")).where("length(w) >= 6")


_W = "SELECT DISTINCT {k}, unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS w FROM {t}"


@query(f"""
WITH d AS (SELECT * FROM ({_W.format(k="doc_id", t="documents")}) WHERE length(w) >= 6), b AS (SELECT * FROM ({_W.format(k="item_id", t="benchmark")}) WHERE length(w) >= 6),
s AS (SELECT w, min(item_id) AS item_id FROM b GROUP BY 1 HAVING count(*) = 1)
SELECT d.doc_id AS src, s.item_id AS dst, CAST(count(*) AS BIGINT) AS n FROM d JOIN s USING (w) WHERE d.doc_id <> s.item_id GROUP BY 1, 2""")
def stem_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from texts to the only holder of a word; words with more holders are ambiguous, self edges go (JON03, GRF05, AGG17)."""
    return findings.stem_edges(words(table(spark, sf_dir, "documents"), "doc_id"), words(table(spark, sf_dir, "benchmark"), "item_id"), "w", "doc_id", "item_id")


@query("""
WITH s AS (SELECT s_suppkey, unnest([s_nationkey, (s_nationkey + 5) % 25]) AS k FROM supplier) SELECT n_nationkey, list_sort(list(s_suppkey)) AS tests FROM nation JOIN s ON k = n_nationkey GROUP BY 1""")
def mapped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with several candidate keys each, collected in order by target (JON05)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 5) % 25)).alias("k"))
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    return s.join(n, F.col("k") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("tests"))


@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS n, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM documents),
t AS (SELECT doc_id, n, trim(regexp_replace(line, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS t FROM l), q AS (SELECT doc_id, n AS cited, t AS quote FROM t WHERE length(t) > 20)
SELECT q.doc_id, q.cited, CAST(min(t.n) AS BIGINT) AS found, CAST(count(*) AS BIGINT) AS places FROM q JOIN t ON t.doc_id = q.doc_id AND t.t = q.quote GROUP BY 1, 2""")
def quote_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line of more than 20 characters stands in its text when it is quoted, white space aside (JON06, PRD21): an equi-join on text and line."""
    l = linescan.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("lineno").cast("long").alias("n"), T.collapsed(F.col("line")).alias("t"))
    q = l.where("length(t) > 20").select("doc_id", F.col("n").alias("cited"), F.col("t").alias("quote"))
    return findings.locate_quotes(q, l)


@query("""
WITH e AS (SELECT user_id, event_type, event_id, list_distinct(list_transform(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), lambda x: x)) AS near FROM events)
SELECT event_id, list_sort(near) AS near FROM e""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands within two rows around each row (WIN21)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return table(spark, sf_dir, "events").select("event_id", F.array_sort(F.collect_set("event_type").over(w)).alias("near"))


@query("""
WITH s AS (SELECT o_custkey AS f, list_sort(list(DISTINCT o_orderpriority)) AS tools FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), c AS (SELECT c_custkey, c_mktsegment, [c_custkey, c_custkey + 1] AS ev FROM customer),
x AS (SELECT c_custkey, unnest(ev) AS f FROM c), j AS (SELECT c_custkey, list_sort(list_distinct(flatten(list(tools)))) AS confirmed_by FROM x JOIN s USING (f) GROUP BY 1)
SELECT c.c_custkey, coalesce(confirmed_by, []) AS confirmed_by, CAST(len(coalesce(confirmed_by, [])) AS BIGINT) AS n FROM customer c LEFT JOIN j USING (c_custkey)""")
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that confirm a row through any of its evidence (JON08)."""
    s = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("f"), F.col("o_orderpriority").alias("tool")).distinct()
    c = table(spark, sf_dir, "customer").select("c_custkey")
    x = c.select("c_custkey", F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1)).alias("f"))
    by = x.join(s, "f").groupBy("c_custkey").agg(F.array_sort(F.collect_set("tool")).alias("by"))
    both = F.coalesce("by", F.array().cast("array<string>"))
    return c.join(by, "c_custkey", "left").select("c_custkey", both.alias("confirmed_by"), F.size(both).cast("long").alias("n"))


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), r AS (SELECT ps AS part, min(s) AS rule FROM (SELECT l_partkey AS ps, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1),
a AS (SELECT l_partkey, rule, count(*) AS n FROM f LEFT JOIN r ON part = l_partkey GROUP BY 1, 2) SELECT l_partkey, rule, CASE WHEN rule IS NULL THEN 'own' ELSE 'absorbed' END AS route, CAST(n AS BIGINT) AS n FROM a""")
def fact_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts absorbed by the first rule of their file, the others rows of their own (JON09)."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    r = l.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("_p")).agg(F.min("l_suppkey").alias("rule"))
    n = l.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return n.join(r, F.col("l_partkey") == F.col("_p"), "left").select("l_partkey", "rule", F.when(F.col("rule").isNull(), "own").otherwise("absorbed").alias("route"), "n")


@query("""
WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part WHERE p_size > 20)
SELECT p.p_partkey, CAST(r.rk AS BIGINT) AS rk, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY r.rk ASC NULLS LAST, p.p_partkey) AS BIGINT) AS place FROM part p LEFT JOIN r ON r.p_partkey = p.p_partkey""")
def ranked_then_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked rows first, those without a rank after them (JON32, SRT04)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    rk = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long")
    r = p.where("p_size > 20").select("p_partkey", rk.alias("rk"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.asc_nulls_last("rk"), "p_partkey")).cast("long")
    return p.select("p_partkey", "p_brand").join(r, "p_partkey", "left").select("p_partkey", "rk", place.alias("place"))


@query("""
WITH b AS (SELECT o_orderkey AS old_id, o_custkey AS k, epoch_us(o_orderdate) // 86400000000 AS line, list_distinct(string_split(lower(o_orderpriority), '-')) AS t FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT o_orderkey AS new_id, o_custkey AS k, epoch_us(o_orderdate) // 86400000000 AS line, list_distinct(string_split(lower(o_orderpriority), '-')) AS t FROM orders WHERE o_orderkey % 2 = 1),
j AS (SELECT new_id, old_id, row_number() OVER (PARTITION BY new_id ORDER BY abs(n.line - b.line), old_id) AS rn FROM n JOIN b ON n.k = b.k AND abs(n.line - b.line) <= 40 AND 2 * len(list_intersect(n.t, b.t)) >= len(b.t))
SELECT new_id, old_id FROM j WHERE rn = 1""")
def key_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows matched to the nearest old row with half its title words (JON12, JON42): keyed by entity and line bucket."""
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), day.alias("line"), F.array_distinct(F.split(F.lower("o_orderpriority"), "-")).alias("t"))
    b = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("old_id"), "k", F.col("line").alias("old_line"), F.col("t").alias("old_t"))
    n = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("new_id"), "k", "line", "t")
    return findings.migrate_keys(n, b, 40)


@query("""
WITH d AS (SELECT source, lang, count(*) AS files, CAST(count(*) FILTER (WHERE n_chars > 2000) AS BIGINT) AS large FROM documents GROUP BY 1, 2)
SELECT lang, CAST(count(*) AS BIGINT) AS sources, CAST(sum(files) AS BIGINT) AS files, round(sum(large)::DOUBLE / sum(files), 6) AS share FROM d GROUP BY 1 HAVING count(*) >= 2 AND sum(files) >= 2""")
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that spread over several places, with their share in a set (AGG28)."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("files"), F.count_if(F.col("n_chars") > 2000).alias("large"))
    g = d.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("files").alias("files"), F.round(F.sum("large").cast("double") / F.sum("files"), 6).alias("share"))
    return g.where("sources >= 2 and files >= 2")


@query("""
WITH a AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + 10 AS hi FROM orders),
w AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a), i AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM w),
u AS (SELECT o_custkey, g, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY 1, 2) SELECT o_custkey, CAST(sum(hi - lo + 1) AS BIGINT) AS size FROM u GROUP BY 1""")
def covered_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of what a key's distinct ranges cover, overlaps once (AGG22, JON37)."""
    d = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_custkey", d.alias("lo"), F.date_add(d, 10).alias("hi")).distinct()
    u = windows.interval_union(o, ["o_custkey"], "lo", "hi")
    return u.groupBy("o_custkey").agg(F.sum(F.datediff("hi", "lo") + 1).cast("long").alias("size"))


@query("""
SELECT lang, CAST(count(*) AS BIGINT) AS raw, CAST(count(*) FILTER (WHERE length(text) < 100) AS BIGINT) AS dropped, CAST(count(*) FILTER (WHERE length(text) >= 100 AND contains(text, '***')) AS BIGINT) AS failed,
 CAST(count(*) FILTER (WHERE length(text) >= 100 AND NOT contains(text, '***')) AS BIGINT) AS kept FROM documents GROUP BY 1""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each family reach each stage (AGG25, AGG26)."""
    status = F.when(F.length("text") < 100, "dropped").when(F.contains("text", F.lit("***")), "failed").otherwise("kept")
    g = table(spark, sf_dir, "documents").groupBy("lang")
    n = lambda s: F.count_if(status == s).alias(s)
    return g.agg(F.count("*").alias("raw"), n("dropped"), n("failed"), n("kept"))


@query(r"""
WITH k AS (SELECT doc_id, CASE WHEN regexp_matches(text, 'AKIA') THEN 0 WHEN contains(text, '***') THEN 1 WHEN contains(text, ' | ') THEN 2 ELSE 3 END AS kind, n_chars FROM documents)
SELECT doc_id, CAST(kind AS INTEGER) AS kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY n_chars DESC, doc_id) AS BIGINT) AS place FROM k""")
def leads_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of several kinds in one order within their kind (SRT05, JON38, PRD07)."""
    t = F.col("text")
    kind = F.when(t.rlike("AKIA"), 0).when(F.contains(t, F.lit("***")), 1).when(F.contains(t, F.lit(" | ")), 2).otherwise(3)
    d = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), "n_chars")
    return d.select("doc_id", "kind", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("place"))


@query("""SELECT doc_id, lang FROM documents WHERE coalesce(n_chars, 0) >= 500 AND NOT (source = 'src1' OR starts_with(source, 'src2')) ORDER BY doc_id LIMIT 200""")
def first_in_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 in scan order, as a hard limit (SRT08, PRD16, PRD17)."""
    out = ~F.exists(F.array("source"), lambda s: (s == "src1") | s.like("src2%"))
    d = table(spark, sf_dir, "documents").where((F.coalesce("n_chars", F.lit(0)) >= 500) & out)
    return d.select("doc_id", "lang").orderBy("doc_id").limit(200)


@query("""
WITH n AS (SELECT DISTINCT regexp_extract(lower(text), '[a-z]{6,}') AS name FROM benchmark WHERE regexp_matches(lower(text), '[a-z]{6,}')), d AS (SELECT doc_id, list_distinct(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS w FROM documents)
SELECT name, CAST(count(*) AS BIGINT) AS docs FROM (SELECT DISTINCT name FROM n) JOIN (SELECT doc_id, unnest(w) AS name FROM d) USING (name) GROUP BY 1""")
def names_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names stand as whole words in which texts (JON23, JON39, FUN31): token join, no regex per pair."""
    n = table(spark, sf_dir, "benchmark").select(F.regexp_extract(F.lower("text"), "[a-z]{6,}", 0).alias("w")).where("w <> ''").distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "))).alias("w"))
    return d.join(n, "w").groupBy(F.col("w").alias("name")).agg(F.count("*").alias("docs"))


@query(r"""
WITH h AS (SELECT page_id, regexp_extract(url, '#(.*)$', 1) AS frag FROM pages), t AS (SELECT page_id, unnest(['Top', 'top', 'end']) AS slug FROM pages)
SELECT h.page_id, frag, CASE WHEN bool_or(slug = frag) THEN 'exact' WHEN bool_or(lower(slug) = lower(frag)) THEN 'case' ELSE 'none' END AS how FROM h JOIN t USING (page_id) WHERE frag <> '' GROUP BY 1, 2""")
def fragment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link's fragment, decoded, matched exactly or but for case (FUN24)."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "#(.*)$", 1).alias("frag")).where("frag <> ''")
    plain = F.coalesce(F.try_url_decode("frag"), F.col("frag"))
    slugs = F.array(F.lit("Top"), F.lit("top"), F.lit("end"))
    how = F.when(F.array_contains(slugs, plain), "exact").when(F.exists(slugs, lambda s: F.lower(s) == F.lower(plain)), "case").otherwise("none")
    return p.select("page_id", "frag", how.alias("how"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), g AS (SELECT bool_or(contains(line, '***')) AS any FROM l)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM l, g WHERE contains(line, '!!') AND g.any GROUP BY 1""")
def gated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by text that hold only where some text anywhere has a mark (FUN34): one broadcast row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    gate = d.agg(F.bool_or(F.contains("text", F.lit("***"))).alias("_any"))
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("!!")))).cast("long")
    return d.select("doc_id", n.alias("n")).where("n > 0").join(F.broadcast(gate)).where("_any").select("doc_id", "n")


@query(r"""
WITH c AS (SELECT conv_id, turn, '```json' || chr(10) || '{"verdict": "' || role || '", "n": ' || turn || '}' || chr(10) || '```' AS reply FROM conversations)
SELECT conv_id, turn, regexp_extract(reply, '"verdict": "([a-z]+)"', 1) AS verdict, CAST(regexp_extract(reply, '"n": ([0-9]+)', 1) AS BIGINT) AS n FROM c""")
def unwrapped_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON taken out of fenced replies (FUN38, NRM13's shape)."""
    reply = F.concat(F.lit('```json\n{"verdict": "'), "role", F.lit('", "n": '), F.col("turn").cast("string"), F.lit("}\n```"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", findings.unwrapped(reply).alias("j"))
    return c.select("conv_id", "turn", F.from_json("j", "verdict string, n long").alias("v")).select("conv_id", "turn", "v.*")


@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS lineno, regexp_matches(line, '[A-Z]+-[0-9]+') AS ticket FROM l WHERE regexp_matches(line, '\bMIT\b')""")
def marked_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a marker and whether they name a ticket (FUN27)."""
    l = linescan.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("line").rlike(r"\bMIT\b"))
    return l.select("doc_id", F.col("lineno").cast("long").alias("lineno"), F.col("line").rlike("[A-Z]+-[0-9]+").alias("ticket"))


@query("""
WITH g AS (SELECT n_regionkey, n_nationkey, n_name FROM nation), c AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)
SELECT r_regionkey, coalesce(min_by(n_name, (-n, n_nationkey)), 'none') AS target FROM region LEFT JOIN (SELECT * FROM g JOIN c ON s_nationkey = n_nationkey) ON n_regionkey = r_regionkey GROUP BY 1""")
def best_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several homes, or none (JON24)."""
    c = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    g = table(spark, sf_dir, "nation").join(c, F.col("s_nationkey") == F.col("n_nationkey"))
    r = table(spark, sf_dir, "region").select("r_regionkey").join(g, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    best = F.min_by("n_name", F.struct((-F.col("n")).alias("n"), "n_nationkey"))
    return r.groupBy("r_regionkey").agg(F.coalesce(best, F.lit("none")).alias("target"))


@query("""
WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN NULL ELSE o_orderdate END AS until, o_orderstatus, o_totalprice FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice IS NULL THEN 'price' WHEN o_orderstatus = 'O' AND until IS NULL THEN 'until' END AS missing, coalesce(until, TIMESTAMP '2000-01-01') AS until FROM x""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a row of its kind must have, and defaults (PRD26)."""
    until = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", until.alias("until"))
    missing = F.when((F.col("o_orderstatus") == "F") & F.col("o_totalprice").isNull(), "price").when((F.col("o_orderstatus") == "O") & F.col("until").isNull(), "until")
    return o.select("o_orderkey", missing.alias("missing"), F.coalesce("until", F.lit("2000-01-01").cast("timestamp_ntz")).alias("until"))
