"""Queries of quotes, expected texts and ordered edits over documents, orders and nations, with SQL that tries every place in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import edits as E
from millrace.plans.registry import query
from millrace.sources.tables import table


@query(r"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l, len(l) AS total, doc_id % len(l) + 1 AS s, least(len(l), doc_id % len(l) + 1 + doc_id // 7 % 20) AS e FROM d),
q AS (SELECT doc_id, l, total, replace(CASE doc_id % 2 WHEN 0 THEN array_to_string(l[s:e], chr(10)) ELSE array_to_string(l[s:e], '   ') END, ' ', '  ') || CASE doc_id % 5 WHEN 0 THEN ' nowhere' ELSE '' END AS body, s + doc_id % 3 - 1 AS a, e + doc_id % 3 - 1 AS b FROM p),
n AS (SELECT doc_id, total, list_transform(l, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS l, trim(regexp_replace(body, '\s+', ' ', 'g')) AS body, least(20, greatest(6, len(string_split(body, chr(10))))) AS most, a, b FROM q),
c AS (SELECT doc_id, true AS cited, greatest(a, 1) AS s, least(total, greatest(a, b)) AS e, l, body FROM n
 UNION ALL SELECT doc_id, false, s, s + w - 1, l, body FROM (SELECT *, unnest(range(1, total + 1)) AS s FROM n), range(1, 21) r(w) WHERE w <= most AND s + w - 1 <= total),
f AS (SELECT doc_id, cited, s, e FROM c WHERE s <= e AND body <> '' AND array_to_string(list_filter(l[s:e], lambda x: x <> ''), ' ') = body),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY NOT cited, e - s, s) AS r FROM f)
SELECT d.doc_id AS quote, CAST(s AS INTEGER) AS first, CAST(e AS INTEGER) AS last, cited FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND r = 1""")
def quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote of 1 to 20 lines of every document, its white space changed and its place told wrong for some, found again (JON06)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    l, d, n = F.col("l"), F.col("doc"), F.size("l")
    s = (d % n + 1).cast("int")
    e = F.least(n, (s + F.floor(d / 7) % 20).cast("int"))
    at = docs.select("doc", T.lines(F.col("text")).alias("l")).select("doc", "l", s.alias("s"), e.alias("e"))
    body = F.array_join(F.slice(l, F.col("s"), F.col("e") - F.col("s") + 1), "\n")
    spaced = F.replace(F.when(d % 2 == 0, body).otherwise(F.replace(body, F.lit("\n"), F.lit("   "))), F.lit(" "), F.lit("  "))
    off = (d % 3 - 1).cast("int")
    quotes = at.select(d.alias("quote"), "doc", F.concat(spaced, F.when(d % 5 == 0, " nowhere").otherwise("")).alias("body"), (F.col("s") + off).alias("first"), (F.col("e") + off).alias("last"))
    return E.located_quotes(docs, quotes)


@query(r"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS t FROM documents),
p AS (SELECT doc_id, list_concat(t, list_transform(t, lambda x: '  ' || x)) AS l, len(t) AS half, doc_id % len(t) + 1 AS s, least(len(t), doc_id % len(t) + 1 + doc_id // 6 % 4) AS e FROM d),
q AS (SELECT doc_id, l, doc_id % 6 AS kind, CASE doc_id % 6 WHEN 3 THEN 2 * half WHEN 4 THEN half + s ELSE s END AS a, CASE doc_id % 6 WHEN 3 THEN 2 * half + 1 WHEN 4 THEN half + e ELSE e END AS b, l[s:e] AS own FROM p),
w AS (SELECT doc_id, l, a, b, CASE kind WHEN 1 THEN list_transform(own, lambda x: '    ' || x) WHEN 2 THEN list_transform(own, lambda x: x || ' changed') WHEN 5 THEN list_concat(own, ['one more']) ELSE own END AS was,
 ['first', '      second', '', '    third'] AS new FROM q),
j AS (SELECT *, b <= len(l) AS within, l[a:b] AS now FROM w),
k AS (SELECT *, within AND was = now AS same, within AND list_transform(was, lambda x: ltrim(x)) = list_transform(now, lambda x: ltrim(x)) AS alike FROM j),
o AS (SELECT doc_id, min(s) AS other FROM (SELECT doc_id, l, was, unnest(range(1, len(l) - len(was) + 2)) AS s FROM k WHERE alike AND NOT same) WHERE l[s:s + len(was) - 1] = was GROUP BY 1),
v AS (SELECT k.*, other, CASE WHEN NOT within THEN 'outside' WHEN same THEN 'same' WHEN NOT alike THEN 'mismatch' WHEN other IS NOT NULL THEN 'elsewhere' ELSE 'repaired' END AS state FROM k LEFT JOIN o USING (doc_id)),
m AS (SELECT *, list_transform(new, lambda x, i: CASE WHEN trim(x) = '' THEN x ELSE regexp_extract(now[least(i, len(now))], '^\s*') || CASE WHEN starts_with(x, regexp_extract(was[least(i, len(now))], '^\s*')) THEN x[length(regexp_extract(was[least(i, len(now))], '^\s*')) + 1:] ELSE x END END) AS shifted FROM v)
SELECT doc_id AS edit, state, CAST(CASE WHEN state = 'elsewhere' THEN other END AS INTEGER) AS other, array_to_string(CASE WHEN state = 'repaired' THEN now ELSE was END, chr(10)) AS old, array_to_string(CASE WHEN state = 'repaired' THEN shifted ELSE new END, chr(10)) AS new FROM m""")
def expected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit for every document, which has its lines once plain and once indented: its old text as it is, indented, changed, outside or elsewhere (PRD21)."""
    d, t, l = F.col("doc"), F.col("t"), F.col("l")
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.lines(F.col("text")).alias("t"))
    half = F.size(t)
    s = (d % half + 1).cast("int")
    at = own.select("doc", F.concat(t, F.transform(t, lambda x: F.concat(F.lit("  "), x))).alias("l"), half.alias("half"), s.alias("s"), F.least(half, (s + F.floor(d / 6) % 4).cast("int")).alias("e"))
    plain, kind = F.slice(l, F.col("s"), F.col("e") - F.col("s") + 1), d % 6
    was = F.when(kind == 1, F.transform(plain, lambda x: F.concat(F.lit("    "), x))).when(kind == 2, F.transform(plain, lambda x: F.concat(x, F.lit(" changed"))))
    was = was.when(kind == 5, F.concat(plain, F.array(F.lit("one more")))).otherwise(plain)
    place = lambda c, beyond: F.when(kind == 3, 2 * F.col("half") + beyond).when(kind == 4, F.col("half") + F.col(c)).otherwise(F.col(c))
    edits = at.select(d.alias("edit"), "doc", place("s", 0).alias("first"), place("e", 1).alias("last"), F.array_join(was, "\n").alias("old"), F.lit("first\n      second\n\n    third").alias("new"))
    return E.matched_edits(at.select("doc", F.array_join("l", "\n").alias("text")), edits)


_SLUG = r"regexp_extract(x, '\]\(#([^)\s]+)\)', 1)"
_PROJECTED = f"list_transform({{lines}}, lambda x: CASE WHEN len(list_filter({{names}}, lambda v: v.o = {_SLUG} AND v.n IS NOT NULL)) > 0 THEN replace(x, '(#' || {_SLUG} || ')', '(#' || list_filter({{names}}, lambda v: v.o = {_SLUG})[1].n || ')') ELSE x END)"
_BASES = "list_transform(list_filter({lines}, lambda x: starts_with(x, '## ')), lambda x: lower(replace(x[4:], ' ', '-')))"
_SLUGS = "list_transform({bases}, lambda x, i: CASE WHEN len(list_filter({bases}[1:i - 1], lambda y: y = x)) > 0 THEN x || '-' || len(list_filter({bases}[1:i - 1], lambda y: y = x)) ELSE x END)"
_PLACES = "list_filter(range(1, len({lines}) + 1), lambda i: starts_with({lines}[i], '## '))"
_LOST = rf"""list_concat(list_filter(list_transform(list_filter({{lines}}, lambda x: contains(x, '](#')), lambda x: {_SLUG}), lambda y: NOT list_contains({{slugs}}, y)),
 list_filter(list_transform(list_filter({{lines}}, lambda x: contains(x, '`src/')), lambda x: regexp_extract(x, '`([^`]+)`', 1)), lambda y: NOT list_contains(paths, y)))"""
_HEADS = "list_filter(list_transform({places}, lambda p, k: {{'p': p, 's': {slugs}[k], 'twice': len(list_filter({bases}, lambda y: y = {bases}[k])) > 1}}), lambda h: h.p >= a AND h.p <= {last})"


def _state(lines: str, names: str, tag: str, more: str, source: str) -> str:
    """Two levels of columns on top of ``source``: the lines with their links rewritten, their slugs, and what they lack."""
    inner = f"SELECT *, {_PROJECTED.format(lines=lines, names=names)} AS p_{tag} FROM ({source})"
    bases = f"SELECT *, {_BASES.format(lines=f'p_{tag}')} AS b_{tag} FROM ({inner})"
    slugs = f"SELECT *, {_SLUGS.format(bases=f'b_{tag}')} AS g_{tag} FROM ({bases})"
    return f"SELECT *, {_LOST.format(lines=f'p_{tag}', slugs=f'g_{tag}')} AS lost_{tag}{more} FROM ({slugs})"


_TRIED = f"""SELECT s.*, e.edit, e.a, e.b, e.was, e.added, s.lines[e.a:e.b] = e.was AND e.b <= len(s.lines) AS fits, list_concat(s.lines[1:e.a - 1], e.added, s.lines[e.b + 1:]) AS tried,
 {_BASES.format(lines="s.lines")} AS b0, {_PLACES.format(lines="s.lines")} AS at0 FROM state s JOIN e ON e.doc = s.doc AND e.r = s.r"""
_TRIED = f"SELECT *, {_SLUGS.format(bases='b0')} AS g0, {_BASES.format(lines='tried')} AS b1, {_PLACES.format(lines='tried')} AS at1 FROM ({_TRIED})"
_TRIED = f"SELECT *, {_SLUGS.format(bases='b1')} AS g1 FROM ({_TRIED})"
_TRIED = f"SELECT *, {_HEADS.format(places='at0', slugs='g0', bases='b0', last='b')} AS h0, {_HEADS.format(places='at1', slugs='g1', bases='b1', last='a + len(added) - 1')} AS h1 FROM ({_TRIED})"
_TRIED = f"SELECT *, CASE WHEN len(h0) = len(h1) THEN list_filter(list_transform(h0, lambda h, k: {{'o': h.s, 'n': CASE WHEN h.twice OR h1[k].twice THEN NULL ELSE h1[k].s END, 'differs': h.s <> h1[k].s}}), lambda x: x.differs) ELSE [] END AS pairs FROM ({_TRIED})"
_TRIED = f"SELECT *, list_concat(list_filter(names, lambda v: NOT list_contains(list_transform(pairs, lambda x: x.o), v.o)), list_transform(pairs, lambda x: {{'o': x.o, 'n': x.n}})) AS own FROM ({_TRIED})"
_STEP = _state("tried", "own", "1", "", _state("lines", "names", "0", "", _TRIED))
_STEP = f"SELECT *, fits AND len(list_filter(lost_1, lambda y: len(list_filter(lost_1, lambda z: z = y)) > len(list_filter(lost_0, lambda z: z = y)))) = 0 AS ok FROM ({_STEP})"
_ORDER_LINE = "CASE CAST({m} % 7 AS INTEGER) WHEN 0 THEN '## Part ' || ({m} // 7 % 4) WHEN 1 THEN 'See [it](#part-' || ({m} // 7 % 4) || ').' WHEN 2 THEN 'Run `src/f' || ({m} // 7 % 40) || '.py` now.' ELSE 'Plain ' || ({m} % 3) END"
_NEW = "CASE CAST(m // 3 % 6 AS INTEGER) WHEN 0 THEN [] WHEN 1 THEN ['## Part ' || (m // 18 % 4)] WHEN 2 THEN ['See [it](#part-' || (m // 18 % 4) || ').'] WHEN 3 THEN ['Run `src/f' || (m // 18 % 40) || '.py` now.'] WHEN 4 THEN ['Plain 7', '## Part ' || (m // 18 % 4)] ELSE ['Plain 9'] END"


@query(rf"""
WITH RECURSIVE l AS (SELECT o_custkey AS doc, o_orderkey // 4 AS m, o_orderkey AS edit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total, {_ORDER_LINE.format(m="(o_orderkey // 4)")} AS line FROM orders),
d AS (SELECT doc, list(line ORDER BY n) AS lines, (SELECT list('src/f' || n_nationkey || '.py') FROM nation) AS paths FROM l GROUP BY 1),
e AS (SELECT l.doc, edit, n AS a, least(n + m % 2, total) AS b, CASE WHEN m % 11 = 0 THEN ['stale'] ELSE d.lines[n:least(n + m % 2, total)] END AS was, {_NEW} AS added,
 row_number() OVER (PARTITION BY l.doc ORDER BY n DESC, least(n + m % 2, total) DESC) AS r FROM l JOIN d ON d.doc = l.doc WHERE m % 5 <> 0),
state AS (SELECT doc, 1 AS r, lines, paths, []::STRUCT(o VARCHAR, n VARCHAR)[] AS names, []::VARCHAR[] AS said FROM d WHERE doc IN (SELECT doc FROM e)
 UNION ALL SELECT doc, r + 1, CASE WHEN ok THEN tried ELSE lines END, paths, CASE WHEN ok THEN own ELSE names END, list_append(said, edit || ':' || CASE WHEN NOT fits THEN 'old-mismatch' WHEN ok THEN 'applied' ELSE 'recheck-failed' END) FROM ({_STEP})),
z AS (SELECT doc, lines, names, said FROM state WHERE r = len(said) + 1 AND r = (SELECT count(*) + 1 FROM e WHERE e.doc = state.doc))
SELECT doc, CASE WHEN len(lines) = 0 THEN '' ELSE array_to_string({_PROJECTED.format(lines="lines", names="names")}, chr(10)) || chr(10) END AS text, array_to_string(said, ',') AS said FROM z""")
def ordered_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of one or two lines, which may overlap, in texts whose lines a customer's orders pick: each applied, or taken back alone (WIN20, JON31)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("edit"), F.expr("o_orderkey div 4").alias("m"))
    line = F.expr("CASE m % 7 WHEN 0 THEN '## Part ' || (m div 7 % 4) WHEN 1 THEN 'See [it](#part-' || (m div 7 % 4) || ').' WHEN 2 THEN 'Run `src/f' || (m div 7 % 40) || '.py` now.' ELSE 'Plain ' || (m % 3) END")
    gathered = o.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("edit", "m", line.alias("line")))).alias("x")).select("doc", "x", F.transform("x", lambda v: v["line"]).alias("lines"))
    docs = gathered.select("doc", F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("text"))
    each = gathered.select("doc", "lines", F.posexplode("x").alias("at", "v")).select("doc", "lines", (F.col("at") + 1).alias("first"), "v.edit", "v.m").where("m % 5 <> 0")
    each = each.withColumn("last", F.least(F.col("first") + (F.col("m") % 2).cast("int"), F.size("lines")))
    new = F.expr("CASE m div 3 % 6 WHEN 0 THEN '' WHEN 1 THEN '## Part ' || (m div 18 % 4) WHEN 2 THEN 'See [it](#part-' || (m div 18 % 4) || ').' WHEN 3 THEN 'Run `src/f' || (m div 18 % 40) || '.py` now.' WHEN 4 THEN 'Plain 7\n## Part ' || (m div 18 % 4) ELSE 'Plain 9' END")
    old = F.when(F.col("m") % 11 == 0, "stale").otherwise(F.array_join(F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1), "\n"))
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("src/f"), "n_nationkey", F.lit(".py")).alias("path"))
    out = E.applied_edits(docs, each.select("doc", "edit", "first", "last", old.alias("old"), new.alias("new")), known)
    return out.select("doc", "text", F.array_join(F.transform("edits", lambda x: F.concat(x["edit"].cast("string"), F.lit(":"), x["status"])), ",").alias("said"))
