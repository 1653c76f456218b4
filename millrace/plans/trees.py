"""Queries of the area split and of findings against a baseline, over files and findings that orders stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import areas, baseline
from millrace.plans.registry import query
from millrace.sources.tables import table

_M = "(o_orderkey // 4)"
_PATH = f"CASE WHEN {_M} % 13 = 0 THEN '' ELSE 'd' || ({_M} % 4) || '/' || CASE WHEN {_M} // 4 % 3 > 0 THEN 'e' || ({_M} // 12 % 5) || '/' || CASE WHEN {_M} // 60 % 2 > 0 THEN 'g' || ({_M} // 120 % 3) || '/' ELSE '' END ELSE '' END END || 'f' || o_orderkey || '.py'"


def _packed(name: str, source: str, keys: str, order: str) -> str:
    """SQL of a greedy packing: ``source`` with ``lines`` and a row number ``r`` by ``order``, one row a step."""
    same = " AND ".join(f"n.{k.strip()} IS NOT DISTINCT FROM p.{k.strip()}" for k in keys.split(","))
    return f"""{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS r FROM {source}),
{name} AS (SELECT *, lines AS used, 0 AS pack FROM {name}_n WHERE r = 1 UNION ALL SELECT n.*, CASE WHEN p.used + n.lines > 400 THEN n.lines ELSE p.used + n.lines END, CASE WHEN p.used + n.lines > 400 THEN p.pack + 1 ELSE p.pack END FROM {name} p JOIN {name}_n n ON {same} AND n.r = p.r + 1)"""


@query(f"""
WITH RECURSIVE f AS (SELECT o_custkey % 20 AS repo, {_PATH} AS path, 1 + {_M} * 7 % 61 AS lines FROM orders),
a AS (SELECT repo, path, lines, k AS depth, array_to_string(string_split(path, '/')[1:k], '/') AS folder FROM f, range(0, 6) x(k) WHERE k < len(string_split(path, '/'))),
w AS (SELECT repo, folder, sum(lines) AS weight, min(path) AS first FROM a GROUP BY ALL),
u AS (SELECT a.repo, path, any_value(lines) AS lines, arg_min(folder, depth) FILTER (WHERE weight <= 400) AS unit, arg_max(folder, depth) AS own FROM a JOIN w USING (repo, folder) GROUP BY ALL),
l AS (SELECT repo, own AS parent, path, lines FROM u WHERE unit IS NULL), {_packed("lp", "l", "repo, parent", "path")},
lf AS (SELECT *, min(path) OVER (PARTITION BY repo, parent, pack) AS first, sum(lines) OVER (PARTITION BY repo, parent, pack) AS total FROM lp),
d AS (SELECT u.repo, path, CASE WHEN unit = '' THEN NULL ELSE regexp_replace(unit, '/?[^/]*$', '') END AS parent, w.first, weight FROM u JOIN w ON w.repo = u.repo AND w.folder = unit),
s AS (SELECT DISTINCT repo, parent, first, total AS lines FROM lf UNION ALL SELECT DISTINCT repo, parent, first, weight FROM d UNION ALL SELECT repo, regexp_replace(folder, '/?[^/]*$', ''), first, NULL FROM w WHERE weight > 400 AND folder <> ''),
t AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE lines IS NULL) OVER (PARTITION BY repo, parent ORDER BY first, lines IS NOT NULL ROWS UNBOUNDED PRECEDING) AS run FROM s) WHERE lines IS NOT NULL), {_packed("m", "t", "repo, parent, run", "first")},
z AS (SELECT *, min(first) OVER (PARTITION BY repo, parent, run, pack) AS area FROM m),
p AS (SELECT repo, parent, path, first FROM lf UNION ALL SELECT repo, parent, path, first FROM d)
SELECT p.repo, p.path, z.area FROM p JOIN z ON z.repo = p.repo AND z.parent IS NOT DISTINCT FROM p.parent AND z.first = p.first""")
def folder_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of deep trees in areas of at most 400 lines (WIN10)."""
    path = _PATH.replace("//", "div")
    files = table(spark, sf_dir, "orders").select(F.expr("o_custkey % 20").alias("repo"), F.expr(path).alias("path"), F.expr("1 + (o_orderkey div 4) * 7 % 61").alias("lines"))
    return areas.areas(files, 400)


_FIELDS = "'f' || (o_custkey % 3) AS family, CASE WHEN m % 41 = 0 THEN NULL ELSE 'src/' || (o_custkey % 50) || '.py' END AS file, CAST(1 + m * 13 % 997 AS INTEGER) AS line, o_orderpriority || ' ' || o_orderstatus || CASE m % 2 WHEN 0 THEN ' Catch' ELSE ' catch-all' END AS title"
_OLD = f"SELECT CAST(o_orderkey AS VARCHAR) AS key, {_FIELDS}, CASE m % 5 WHEN 0 THEN 'rejected' WHEN 4 THEN 'pending' ELSE 'accepted' END AS status, CASE m % 5 WHEN 1 THEN '1996-01-01' WHEN 2 THEN 'soon' WHEN 3 THEN '1999-01-01' END AS until FROM o WHERE m % 3 <> 0"
_NOW = f"SELECT CAST(o_orderkey AS VARCHAR) AS key, {_FIELDS.replace('1 + m * 13 % 997', '1 + m * 13 % 997 + CASE WHEN m % 3 = 2 THEN m % 2 ELSE 0 END')} FROM o WHERE m % 3 <> 1"
_DIFF = f"""
WITH RECURSIVE o AS (SELECT *, o_orderkey // 4 AS m FROM orders), old AS MATERIALIZED ({_OLD}), now AS MATERIALIZED ({_NOW}), gone AS (SELECT CAST(o_orderkey AS VARCHAR) AS key FROM o WHERE m % 4 <> 0),
words AS (SELECT key, list_filter(list_distinct(regexp_split_to_array(lower(title), '[^a-z0-9]+')), lambda x: x <> '') AS w FROM (SELECT key, title FROM old UNION ALL SELECT key, title FROM now) GROUP BY key, title),
c AS (SELECT n.family || '|' || n.file AS g, n.key AS new, b.key AS old, abs(n.line - b.line) AS d FROM now n JOIN old b ON n.family = b.family AND n.file = b.file AND abs(n.line - b.line) <= 40 JOIN words x ON x.key = n.key JOIN words y ON y.key = b.key
 WHERE n.key NOT IN (SELECT key FROM old) AND b.key NOT IN (SELECT key FROM now) AND 2 * len(list_intersect(x.w, y.w)) >= len(y.w)),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d, old, new) AS k FROM c),
s AS (SELECT g, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS new, NULL::VARCHAR AS old FROM (SELECT DISTINCT g FROM r)
 UNION ALL SELECT s.g, r.k, CASE WHEN ok THEN list_concat(used, ['n' || r.new, 'o' || r.old]) ELSE used END, CASE WHEN ok THEN r.new END, CASE WHEN ok THEN r.old END
 FROM s JOIN r ON r.g = s.g AND r.k = s.k + 1, LATERAL (SELECT NOT list_contains(s.used, 'n' || r.new) AND NOT list_contains(s.used, 'o' || r.old) AS ok) t),
p AS MATERIALIZED (SELECT new, old FROM s WHERE new IS NOT NULL),
e AS (SELECT n.key, b.key AS matched, CASE WHEN n.line <> b.line THEN 'MOVED' ELSE 'UNCHANGED' END AS kind, status, until FROM now n JOIN old b ON n.key = b.key UNION ALL SELECT new, old, 'EDITED', status, until FROM p JOIN old ON old.key = p.old),
h AS (SELECT *, CASE WHEN status = 'rejected' THEN 'rejected' WHEN status = 'accepted' AND NOT (until IS NOT NULL AND try_cast(until AS DATE) IS NULL) AND coalesce(try_cast(until AS DATE) >= DATE '1997-01-01', true) THEN 'accepted' END AS holds,
 CASE WHEN status = 'accepted' AND until IS NOT NULL AND try_cast(until AS DATE) IS NULL THEN 'until is not a date' WHEN status = 'accepted' AND try_cast(until AS DATE) < DATE '1997-01-01' THEN 'acceptance expired' END AS over FROM e),
diff AS (SELECT key, CASE WHEN holds IS NOT NULL THEN 'SUPPRESSED' ELSE kind END AS state, matched, CASE WHEN holds IS NOT NULL AND kind = 'EDITED' THEN 'suppressed by edited match' WHEN holds IS NULL THEN over END AS note FROM h
 UNION ALL SELECT key, 'NEW', NULL, NULL FROM now WHERE key NOT IN (SELECT key FROM e)
 UNION ALL SELECT key, 'RESOLVED', NULL, CASE WHEN file IS NULL THEN 'file unknown' END FROM old WHERE key NOT IN (SELECT matched FROM e) AND (file IS NULL OR key IN (SELECT key FROM gone)))"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").withColumn("m", F.expr("o_orderkey div 4"))
    family, file = F.expr("'f' || (o_custkey % 3)").alias("family"), F.expr("CASE WHEN m % 41 = 0 THEN NULL ELSE 'src/' || (o_custkey % 50) || '.py' END").alias("file")
    line = F.expr("int(1 + m * 13 % 997)")
    title = F.expr("o_orderpriority || ' ' || o_orderstatus || CASE m % 2 WHEN 0 THEN ' Catch' ELSE ' catch-all' END").alias("title")
    status = F.expr("CASE m % 5 WHEN 0 THEN 'rejected' WHEN 4 THEN 'pending' ELSE 'accepted' END").alias("status")
    until = F.expr("CASE m % 5 WHEN 1 THEN '1996-01-01' WHEN 2 THEN 'soon' WHEN 3 THEN '1999-01-01' END").alias("until")
    key = F.col("o_orderkey").cast("string").alias("key")
    now = o.where("m % 3 <> 1").select(key, family, file, (line + F.expr("int(CASE WHEN m % 3 = 2 THEN m % 2 ELSE 0 END)")).alias("line"), title)
    return now, o.where("m % 3 <> 0").select(key, family, file, line.alias("line"), title, status, until), o.where("m % 4 <> 0").select(key)


@query(f"{_DIFF} SELECT * FROM diff")
def baseline_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings against a baseline in six states, edited ones matched one to one (JON11, JON12)."""
    now, old, gone = _sides(spark, sf_dir)
    return baseline.compared(now, old, gone, "1997-01-01")


@query(f"""{_DIFF}
SELECT n.key, n.family, n.file, n.line, n.title, coalesce(b.status, 'pending') AS status, b.until FROM now n JOIN diff d ON d.key = n.key AND d.state <> 'RESOLVED' LEFT JOIN old b ON b.key = d.matched
UNION ALL SELECT key, family, file, line, title, status, until FROM old WHERE key NOT IN (SELECT matched FROM diff WHERE matched IS NOT NULL) AND key NOT IN (SELECT key FROM diff WHERE state = 'RESOLVED')""")
def baseline_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline after a run: entries go on under the keys that their findings have now (JON42)."""
    now, old, gone = _sides(spark, sf_dir)
    return baseline.recorded(now, old, baseline.compared(now, old, gone, "1997-01-01"))
