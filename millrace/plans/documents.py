"""Text and path queries over documents, pages, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import aggregates, classify, joins, linescan
from millrace.plans.registry import query
from millrace.sources.tables import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM documents),
m AS (SELECT *, CASE WHEN trim(line, ' ') <> '' THEN (4 * (length(regexp_extract(line, '^[ \t]*')) - length(replace(regexp_extract(line, '^[ \t]*'), chr(9), ''))) + length(replace(regexp_extract(line, '^[ \t]*'), chr(9), ''))) // 4 END AS ind FROM l)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE trim(line, ' ') <> '') AS BIGINT) AS loc, CAST(coalesce(sum(ind), 0) AS BIGINT) AS indent_sum, CAST(coalesce(max(ind), 0) AS BIGINT) AS indent_max,
 CAST(count(*) FILTER (WHERE ind >= 4) AS BIGINT) AS n_deep, CAST(max(length(line)) AS BIGINT) AS longest FROM m GROUP BY 1""")
def line_explode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line metrics of every document (SRC04, AGG21, FUN06)."""
    return linescan.line_metrics(linescan.explode_lines(documents(spark, sf_dir), "doc_id", "text"), "doc_id")


@query(r"""
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT suffix(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n_lines,
 length(text) > 2000000 OR contains(left(text, 1024), chr(0)) AS skipped, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents""")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newline count and size guard without an explode (SRC02, SRC03)."""
    t = F.col("text")
    guard = (F.length(t) > 2_000_000) | F.contains(F.left(t, F.lit(1024)), F.lit("\0"))
    return documents(spark, sf_dir).select("doc_id", T.n_lines(t).cast("long").alias("n_lines"), guard.alias("skipped"), F.octet_length(t).cast("long").alias("n_bytes"))


#: Where a fixed pattern looks around, which RE2 cannot, and the same with what it looks at taken along.
_RE2 = {"assertions-disabled": (r"(?<![\w-])-da", r"(?:^|[^\w-])-da"), "tls-disabled": (r"(?<!\w)--insecure", r"(?:^|\W)--insecure"), "numeric-assert": (r"[^\n]*?(?<![\w.])", r"(?:[^\n]*?[^\w.])??")}


def _condition(r: linescan.Rule) -> str:
    """SQL of a rule's fixed pattern, for the counts over all lines; which lines it should hit is told by hand in ``_CASES``."""
    quoted = lambda p: p.replace("'", "''")
    pattern = quoted(r.pattern.replace(*_RE2.get(r.name, ("", ""))) if r.name in _RE2 else r.pattern)
    parts = [f"regexp_matches(line, '{pattern}')"]
    parts += [f"NOT regexp_matches(line, '{quoted(r.exclude)}')"] if r.exclude else []
    parts += [f"regexp_matches(regexp_extract(line, '{pattern}', 1), '{quoted(r.holds)}')"] if r.holds else []
    parts += [f"NOT regexp_matches(regexp_extract(line, '{pattern}', 1), '{quoted(r.lacks)}')"] if r.lacks else []
    parts += [rf"regexp_matches(lower(regexp_replace(line, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '(?:^|[^a-z0-9])(?:{'|'.join(r.words)})(?:[^a-z0-9]|$)')"] if r.words else []
    return " AND ".join(parts)


#: Lines, and by hand the rules that hit them where the scope is theirs.
_CASES = (
    ('# TODO later', 'satd-marker'),
    ('x = todo', ''),
    ('raise NotImplementedError', 'stub'),
    ('implemented', ''),
    ('@pytest.mark.skip(reason)', 'skip-marker'),
    ('skip(it)', ''),
    ('java -da Main', 'assertions-disabled'),
    ('node-da x', ''),
    ('def old_value():', 'legacy-name'),
    ('def bold_value():', ''),
    ('class HTTPClientV1Legacy {', 'legacy-name'),
    ('let goldV1 = 2', 'legacy-name'),
    ('@Deprecated', 'deprecation'),
    ('deprecated', ''),
    ("if flags.isEnabled('x'):", 'flag-sdk conditional-in-test'),
    ('FEATURE_NEW_UI = 1', 'flag-sdk'),
    ('feature_new', ''),
    ('password = "hunter2hunter2"', 'credential'),
    ('password = "${SECRET_VALUE}"', ''),
    ("token: 'your_token_here'", ''),
    ('db.execute("select " + name)', 'string-sql'),
    ('db.execute("select 1")', ''),
    ('eval(x)', 'dynamic-eval'),
    ('medieval(x)', ''),
    ('requests.get(u, verify=False)', 'tls-disabled'),
    ('curl --insecure u', 'tls-disabled'),
    ('x--insecure', ''),
    ('h = md5(a)', 'weak-hash'),
    ('hmd5(a)', ''),
    ('Access-Control-Allow-Origin: *', 'permissive-cors'),
    ('Access-Control-Allow-Origin: https://a', ''),
    ('x  # nosec', 'security-suppression inline-disable'),
    ('// eslint-disable-line security/detect', 'security-suppression inline-disable'),
    ('time.sleep(1)', 'sleep'),
    ('asleep (1)', ''),
    ('@retry', 'retry-marker'),
    ('retries = 3', 'retry-marker'),
    ('t = now()', 'wall-clock'),
    ('knownow', ''),
    ('random.choice(xs)', 'unseeded-random'),
    ('random.seed(3); random.choice(xs)', ''),
    ('try:', 'try-in-test'),
    ('retry:', ''),
    ('    if x:', 'conditional-in-test'),
    ('iffy', ''),
    ('assert x == 42', 'numeric-assert'),
    ('assert x == 4', ''),
    ('assertEqual(a1.22, b)', ''),
    ('expect 3.5', 'numeric-assert'),
    ('print(x)', 'stdout-write'),
    ('reprint (x)', ''),
    ('  echo hello', 'stdout-write'),
    ('x = 1  # noqa', 'inline-disable'),
    ('<!-- this is wrong -->', 'satd-marker'),
    ('/* fix me later */', 'satd-marker'),
    ('plain line', ''),
)
#: The rules of each set of scopes.
_SCOPED = {
    "source tests docs ci config": "satd-marker",
    "source tests": "stub skip-marker",
    "source ci config": "assertions-disabled credential dynamic-eval tls-disabled permissive-cors security-suppression",
    "source": "legacy-name deprecation flag-sdk string-sql weak-hash stdout-write inline-disable",
    "tests": "sleep retry-marker wall-clock unseeded-random try-in-test conditional-in-test numeric-assert",
}
#: The rules of each family.
_FAMILIES = {
    "half-finished": "satd-marker stub skip-marker",
    "error-masking": "assertions-disabled",
    "dead-code": "legacy-name deprecation flag-sdk",
    "security": "credential string-sql dynamic-eval tls-disabled weak-hash permissive-cors security-suppression",
    "test-quality": "sleep retry-marker wall-clock unseeded-random try-in-test conditional-in-test numeric-assert",
    "pipeline-infra": "stdout-write",
    "lint": "inline-disable",
}
_SCOPES = ("source", "tests", "ci", "config", "docs")
_Q = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _told(of: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{rule}', '{name}')" for name, rules in of.items() for rule in rules.split()) + ")"


@query(
    r"WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM documents), h AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{r.name}' AS rule, '{r.family}' AS family FROM l WHERE {_condition(r)}" for r in linescan.RULES + linescan.PROSE)
    + ") SELECT doc_id, rule, family, CAST(count(*) AS BIGINT) AS hits FROM h GROUP BY ALL"
)
def regex_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line rules in one pass over all lines, hits by document and rule (§2.13, AGG16, FUN32)."""
    docs = spread(documents(spark, sf_dir).select("doc_id", "text"))
    hits = linescan.scan_rules(linescan.explode_lines(docs, "doc_id", "text"), linescan.RULES + linescan.PROSE)
    return hits.groupBy("doc_id", "rule", "family").agg(F.count("*").alias("hits"))


@query(f"""
WITH l AS (SELECT CAST(p_partkey % {len(_CASES)} + 1 AS INTEGER) AS k, {_Q(_SCOPES)}[CAST(p_size % {len(_SCOPES)} + 1 AS INTEGER)] AS scope FROM part),
h AS (SELECT {_Q([x for x, _ in _CASES])}[k] AS line, scope, unnest(string_split({_Q([x for _, x in _CASES])}[k], ' ')) AS rule FROM l), s(rule, scopes) AS {_told(_SCOPED)}, f(rule, family) AS {_told(_FAMILIES)}
SELECT scope, line, rule, family, CAST(count(*) AS BIGINT) AS hits FROM h JOIN s USING (rule) JOIN f USING (rule) WHERE list_contains(string_split(scopes, ' '), scope) GROUP BY ALL""")
def line_rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line rule on lines that it hits and lines that it does not, in the scopes of files (§2.13)."""
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    l = table(spark, sf_dir, "part").select(pick([x for x, _ in _CASES], "p_partkey").alias("line"), pick(_SCOPES, "p_size").alias("scope"))
    return linescan.scan_rules(l, linescan.RULES, scope="scope").groupBy("scope", "line", "rule", "family").agg(F.count("*").alias("hits"))


@query(r"""
WITH l AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CASE CAST(o_orderkey // 4 % 7 AS INTEGER) WHEN 0 THEN 'code()' WHEN 1 THEN '# x = f(1)' WHEN 2 THEN '# return (x)' WHEN 3 THEN '# plain words' WHEN 4 THEN '// if (x) {' WHEN 5 THEN '// }' ELSE '  # def g():' END AS line FROM orders),
c AS (SELECT o_custkey, n, trim(regexp_replace(line, '^\s*(#|//)\s?', ''), ' ') AS body FROM l WHERE regexp_matches(line, '^\s*(#|//)\s?')), i AS (SELECT *, n - row_number() OVER (PARTITION BY o_custkey ORDER BY n) AS run FROM c)
SELECT o_custkey, CAST(min(n) AS INTEGER) AS lo, CAST(max(n) AS INTEGER) AS hi, CAST(count(*) FILTER (WHERE regexp_matches(body, '^(if|return|def)\b|^[A-Za-z_][\w.]*\s*(=[^=]|\()|[;{]$')) AS BIGINT) AS code_like, CAST(count(*) AS BIGINT) AS total FROM i GROUP BY o_custkey, run
HAVING count(*) >= 3 AND 2 * count(*) FILTER (WHERE regexp_matches(body, '^(if|return|def)\b|^[A-Za-z_][\w.]*\s*(=[^=]|\()|[;{]$')) > count(*)
 AND sum(length(body) - length(replace(body, '(', ''))) = sum(length(body) - length(replace(body, ')', ''))) AND sum(length(body) - length(replace(body, '{', ''))) = sum(length(body) - length(replace(body, '}', '')))""")
def commented_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of comment lines that are mostly code, from lines that orders pick (§2.13 commented-out-code)."""
    some = ("code()", "# x = f(1)", "# return (x)", "# plain words", "// if (x) {", "// }", "  # def g():")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    line = F.element_at(F.array(*map(F.lit, some)), (F.floor(F.col("o_orderkey") / 4) % 7 + 1).cast("int"))
    return linescan.commented_code(table(spark, sf_dir, "orders").select("o_custkey", n.alias("lineno"), line.alias("line")), "o_custkey")


@query(r"""
SELECT doc_id, substr(sha1(concat_ws('|', lang, source, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' '))), 1, 16) AS fingerprint, substr(sha256(text), 1, 8) AS block_hash FROM documents""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content keys that ignore white space, and plain digests (FUN01, FUN14, STM06)."""
    return documents(spark, sf_dir).select("doc_id", T.fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("fingerprint"), T.digest(F.col("text"), 8).alias("block_hash"))


@query(r"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '((?i:password|passwd|secret|token|api_?key)["'']?[ ]*[:=][ ]*["'']?[A-Za-z0-9+/_.=-]{4})[A-Za-z0-9+/_.=-]{8,}', '\1***', 'g'), '(AKIA|ghp_|xox[a-z]-|sk_live_)[A-Za-z0-9_-]{12,}', '\1***', 'g') AS masked FROM documents)
SELECT doc_id, sha256(masked) AS masked_hash, sha256(left(masked, 200)) AS cut_hash FROM m""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets masked in whole texts (FUN03), and before a cut to 200 characters (FUN25)."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(T.redacted(F.col("text")), 256).alias("masked_hash"), F.sha2(T.redacted_cut(F.col("text"), 200), 256).alias("cut_hash"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(url, '^[a-z]+://', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:64] AS slug,
 left(regexp_replace(regexp_replace(regexp_replace('failed on ' || url || ' with "' || page_id || '" after ' || page_id, 'https?://[^ \n"'']+', 'URL', 'g'), '"[^"]*"|''[^'']*''', '''?''', 'g'), '[0-9]+', 'N', 'g'), 160) AS error_class FROM pages""")
def slug_and_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of URLs and masked messages (FUN10, FUN18)."""
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    message = F.concat(F.lit("failed on "), "url", F.lit(' with "'), F.col("page_id").cast("string"), F.lit('" after '), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", T.slug(bare).alias("slug"), T.error_class(message).alias("error_class"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS bare FROM pages)
SELECT page_id, 'https://' || bare AS bare, regexp_replace(bare, '[:#\s]', '_', 'g') || ':' || page_id || '-' || (page_id + 3) AS cited, CAST(page_id AS INTEGER) AS lo, CAST(page_id + 3 AS INTEGER) AS hi FROM p""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Userinfo off URLs; citations of every page built and parsed again (FUN04, FUN17)."""
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    cited = F.concat(F.regexp_replace(bare, r"[:#\s]", "_"), F.lit(":"), F.col("page_id").cast("string"), F.lit("-"), (F.col("page_id") + 3).cast("string"))
    out = table(spark, sf_dir, "pages").select("page_id", T.without_userinfo(F.concat(F.lit("https://me:pw"), F.col("page_id").cast("string"), F.lit("@"), bare)).alias("bare"), cited.alias("cited"))
    return out.withColumn("c", T.citation(F.col("cited"))).select("page_id", "bare", "cited", "c.lo", "c.hi")


@query(r"""SELECT item_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS tokens FROM benchmark""")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of each item (FUN09)."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(T.title_tokens(F.col("text"))).alias("tokens"))


PATH_RULES = [("vendored", r"spam|farm"), ("generated", r"\.html$|\?page="), ("tests", r"/(en|fr)/[0-9]*[05]([/?#]|$)"), ("docs", r"^https?://(www|blog)\."), ("source", r"/en/")]


def _case(rules, default, col="url"):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{r}') THEN '{n}'" for n, r in rules) + f" ELSE '{default}' END"


GLOBS = ["*.html", "en/*", "fr/**", "de/8*", "es"]


@query(f"""SELECT page_id, {_case(PATH_RULES, 'other')} AS path_class FROM pages""")
def path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching rule gives the class (PRD01, PRD02, PRD14)."""
    return table(spark, sf_dir, "pages").select("page_id", classify.first_match(F.col("url"), PATH_RULES, "other").alias("path_class"))


_PATH = r"regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
SELECT page_id, path, coalesce({", ".join(f"CASE WHEN regexp_matches(path, '{classify.glob_regex(g)}') THEN {str(not g.startswith('de')).lower()} END" for g in reversed(GLOBS))}) AS state,
 CASE WHEN path = '' THEN 'root' WHEN regexp_matches(path, '[0-9]{{4,}}') THEN 'number' WHEN regexp_matches(path, '\\.html$') THEN 'suffix' WHEN NOT contains(path, '/') THEN 'flat' END AS reason,
 CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS top FROM p""")
def path_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs where the last match wins, the first reason to leave a path out, its top segment (PRD04, PRD05, PRD06, PRD28)."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))
    path = F.col("path")
    reason = classify.first_reason([("root", path == ""), ("number", path.rlike("[0-9]{4,}")), ("suffix", path.rlike(r"\.html$")), ("flat", ~F.contains(path, F.lit("/")))])
    state = classify.last_match(path, [(classify.glob_regex(g), not g.startswith("de")) for g in GLOBS])
    return p.select("page_id", "path", state.alias("state"), reason.alias("reason"), classify.top_segment(path).alias("top"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[\n]', ' ', 'g'), ' ')) AS token FROM benchmark),
t AS (SELECT token FROM w UNION SELECT token || '.md' FROM w UNION SELECT 'src/' || token FROM w UNION SELECT 'http://x/' || token FROM w UNION SELECT '3/4')
SELECT token, regexp_matches(token, '^[A-Za-z0-9_.@-]+(/[A-Za-z0-9_.@-]+)*\.[A-Za-z][A-Za-z0-9]{0,5}$|^([A-Za-z0-9_.@-]+/)+[A-Za-z0-9_.@-]*$') AND NOT regexp_matches(token, '://|[<>{}$*]|^[0-9]+/[0-9]+$|\(\)$') AS is_path,
 CASE WHEN regexp_matches(token, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$') AND regexp_matches(token, '[A-Z]{2}') THEN 'upper' WHEN regexp_matches(token, '[a-z][A-Z]') THEN 'mixed' WHEN regexp_matches(token, '[A-Za-z0-9][_.-][A-Za-z0-9]') THEN 'separated' ELSE 'plain' END AS shape FROM t""")
def token_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokens look like paths, and the shape of names (PRD12, PRD13)."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.regexp_replace("text", r"[\n]", " "), " ")).alias("token")).distinct()
    t = w.select(F.explode(F.array("token", F.concat("token", F.lit(".md")), F.concat(F.lit("src/"), "token"), F.concat(F.lit("http://x/"), "token"), F.lit("3/4"))).alias("token")).distinct()
    return t.select("token", classify.is_path(F.col("token")).alias("is_path"), classify.name_shape(F.col("token")).alias("shape"))


@query(r"""WITH l AS (SELECT doc_id, lineno, line FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS lineno FROM documents)),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(The|Der|Les?|El|La) ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lineno ROWS UNBOUNDED PRECEDING) AS segment FROM l)
SELECT doc_id, CAST(segment AS BIGINT) AS segment, CAST(min(lineno) AS BIGINT) AS lo, CAST(max(lineno) AS BIGINT) AS hi, bool_or(contains(line, '!!')) AS holds FROM s WHERE segment > 0 GROUP BY 1, 2""")
def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between start lines and whether one of their lines holds a mark (FUN33, WIN22)."""
    l = linescan.explode_lines(documents(spark, sf_dir), "doc_id", "text")
    return linescan.segments(l, "doc_id", F.col("line").rlike("^(The|Der|Les?|El|La) "), F.contains(F.col("line"), F.lit("!!")))


@query(r"""WITH d AS (SELECT lang, quality = 1 AS actual, length(text) > 300 AND NOT regexp_matches(text, '[#*$%&]{3}') AS predicted FROM documents JOIN labels USING (doc_id))
SELECT lang, CAST(count(*) FILTER (WHERE predicted AND actual) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE predicted) AS BIGINT) AS n_predicted, CAST(count(*) FILTER (WHERE actual) AS BIGINT) AS n_actual, CAST(count(*) FILTER (WHERE predicted AND NOT actual) AS BIGINT) AS decoys,
 round(count(*) FILTER (WHERE predicted AND actual)::DOUBLE / nullif(count(*) FILTER (WHERE predicted), 0), 3) AS "precision", round(count(*) FILTER (WHERE predicted AND actual)::DOUBLE / nullif(count(*) FILTER (WHERE actual), 0), 3) AS recall FROM d GROUP BY 1""")
def truth_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of a rule against labels, by language (AGG11)."""
    predicted = (F.length("text") > 300) & ~F.col("text").rlike("[#*$%&]{3}")
    d = documents(spark, sf_dir).select("doc_id", "lang", predicted.alias("predicted")).join(table(spark, sf_dir, "labels"), "doc_id")
    return aggregates.evaluation(d.withColumn("actual", F.col("quality") == 1), "lang")


@query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(text, '[ \t\n\r\f\v]+'))) AS word FROM documents),
b AS (SELECT item_id, unnest(list_distinct(regexp_split_to_array(text, '[ \t\n\r\f\v]+'))) AS word FROM benchmark),
u AS (SELECT DISTINCT word FROM b WHERE word <> '')
SELECT word, word IN (SELECT word FROM w) AS present FROM u""")
def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which whole words of the benchmark the corpus has (PRD22): token tables and one join."""
    tokens = lambda df: df.select(F.explode(F.array_distinct(F.split("text", r"[ \t\n\r\f\x0B]+"))).alias("word")).where("word <> ''").distinct()
    u, w = tokens(table(spark, sf_dir, "benchmark")), tokens(documents(spark, sf_dir)).withColumn("_p", F.lit(True))
    return u.join(w, "word", "left").select("word", F.coalesce("_p", F.lit(False)).alias("present"))


@query(r"""SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant', 'system') THEN 'role' WHEN text = '' THEN 'empty' WHEN length(text) > 1500 THEN 'long' WHEN turn < 0 THEN 'turn' END AS reason FROM conversations""")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's first reject reason, null where it is valid (PRD10, PRD20)."""
    reason = classify.first_reason([("role", ~F.col("role").isin("user", "assistant", "system")), ("empty", F.col("text") == ""), ("long", F.length("text") > 1500), ("turn", F.col("turn") < 0)])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"))


@query(r"""WITH a AS (SELECT conv_id, turn, string_split(text, ' ') AS old, list_concat(list_concat(string_split(text, ' ')[1:2], ['new', 'words']), string_split(text, ' ')[3:]) AS one,
 list_concat(list_concat(['x'], string_split(text, ' ')), ['y']) AS two FROM conversations)
SELECT conv_id, turn, len(one) - len(old) BETWEEN 1 AND 4 AND len(list_filter(range(0, len(old) + 1), lambda k: one[1:k] = old[1:k] AND one[k + len(one) - len(old) + 1:] = old[k + 1:])) > 0 AS one_span, len(two) - len(old) BETWEEN 1 AND 4 AND len(list_filter(range(0, len(old) + 1), lambda k: two[1:k] = old[1:k] AND two[k + len(two) - len(old) + 1:] = old[k + 1:])) > 0 AS two_spans, len(old) - len(old) BETWEEN 1 AND 4 AND len(list_filter(range(0, len(old) + 1), lambda k: old[1:k] = old[1:k] AND old[k + len(old) - len(old) + 1:] = old[k + 1:])) > 0 AS none FROM a""")
def token_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is another with one span put in (PRD23), on texts changed in known ways."""
    old = F.split("text", " ")
    one = F.concat(F.slice(old, 1, 2), F.array(F.lit("new"), F.lit("words")), F.slice(old, F.lit(3), F.size(old)))
    two = F.concat(F.array(F.lit("x")), old, F.array(F.lit("y")))
    c = table(spark, sf_dir, "conversations")
    test = lambda new: classify.extends_by_one_span(old, new, 4)
    return c.select("conv_id", "turn", test(one).alias("one_span"), test(two).alias("two_spans"), test(old).alias("none"))


@query(r"""WITH r(raw) AS (SELECT raw FROM (SELECT unnest(['./a//b/', 'a\b\c.txt', '/abs/' || url, '../up/' || page_id, 'c:/x', 'src/./m/' || page_id || '.py', 'x/..', 'ok']) AS raw FROM pages)),
p AS (SELECT raw, regexp_replace(regexp_replace(regexp_replace(replace(raw, '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '/\.?$', '') AS p FROM r)
SELECT raw, CASE WHEN NOT (regexp_matches(p, '^/|(^|/)\.\.(/|$)|:') OR p = '') THEN p END AS path, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2""")
def path_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in one form, and those refused (PRD11)."""
    i = F.col("page_id").cast("string")
    raw = F.array(F.lit("./a//b/"), F.lit("a\\b\\c.txt"), F.concat(F.lit("/abs/"), "url"), F.concat(F.lit("../up/"), i), F.lit("c:/x"), F.concat(F.lit("src/./m/"), i, F.lit(".py")), F.lit("x/.."), F.lit("ok"))
    r = table(spark, sf_dir, "pages").select(F.explode(raw).alias("raw"))
    return r.select("raw", classify.canonical_path(F.col("raw")).alias("path")).groupBy("raw", "path").agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS s FROM pages),
u AS (SELECT page_id, unnest(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[1:i], '/'))) AS up, generate_subscripts(s, 1) AS depth FROM p),
k AS (SELECT up, count(DISTINCT page_id) AS n FROM u GROUP BY 1 HAVING count(DISTINCT page_id) >= 3)
SELECT page_id, max_by(k.up, depth) AS nearest FROM u LEFT JOIN k USING (up) GROUP BY 1""")
def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest directory above a page that at least three pages share (JON29, GRF03)."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"))
    up = p.select("page_id", F.posexplode(joins.ancestors(F.col("path"))).alias("depth", "up"))
    k = up.groupBy("up").agg(F.count_distinct("page_id").alias("n")).where("n >= 3").select("up")
    best = up.join(k, "up").groupBy("page_id").agg(F.max_by("up", "depth").alias("nearest"))
    return p.select("page_id").join(best, "page_id", "left")


@query(r"""WITH v AS (SELECT p_partkey, (p_size % 5) || '.' || (p_partkey % 20) || '.' || (p_partkey % 7) AS version FROM part)
SELECT p_partkey, version, (string_split(version, '.')[1]::INT, string_split(version, '.')[2]::INT) >= (2, 10) AS at_least,
 CASE WHEN p_partkey % 4 = 0 THEN 'true' WHEN p_partkey % 4 = 1 THEN 'false' WHEN p_partkey % 4 = 3 THEN 'v' || p_partkey END AS cell,
 '/' || lower('api') || '/v' || p_partkey || '/items' AS route, 'APP_RATE_' || p_partkey AS env FROM v JOIN part USING (p_partkey)""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version floors, cell values, routes and environment names (FUN19, FUN20, FUN21)."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    version = F.concat_ws(".", s(F.col("p_size") % 5), s(k % 20), s(k % 7))
    raw = F.when(k % 4 == 0, "`Yes`").when(k % 4 == 1, "off").when(k % 4 == 2, "n/a").otherwise(F.concat(F.lit("'V"), s(k), F.lit("'")))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        version.alias("version"),
        T.at_least(version, F.lit("2.10")).alias("at_least"),
        T.cell_value(raw).alias("cell"),
        T.joined_route(F.lit("/api/"), F.concat(F.lit("/v"), s(k)), F.lit("items/")).alias("route"),
        T.env_name(F.concat(F.lit("app.rate-"), s(k))).alias("env"),
    )


@query(r"""SELECT event_id, regexp_replace(regexp_replace(regexp_replace(event_type || 'HTTPServerCount', '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '$', '').lower() AS snake,
 CASE WHEN contains('x = 1 # ' || event_type, '#') THEN event_type END AS note, CASE WHEN event_type IN ('error', 'click') AND event_id % 7 BETWEEN 1 AND 5 THEN CAST(event_id % 7 AS INTEGER) ELSE 2 END AS severity,
 CASE WHEN value BETWEEN 0 AND 10 THEN round(value, 3) END AS bounded, repeat('`', CAST(greatest(3, event_id % 6 + 1) AS INTEGER)) AS fence FROM events""")
def scalar_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snake case, comments, trusted severities, bounded numbers and fences (FUN08, FUN11, FUN15, FUN22, FUN23)."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        "event_id",
        T.snake(F.concat("event_type", F.lit("HTTPServerCount"))).alias("snake"),
        T.comment(F.concat(F.lit("x = 1 # "), "event_type"), F.lit("#")).alias("note"),
        T.severity(F.col("event_type"), (i % 7).cast("string"), ("error", "click"), F.lit(2)).alias("severity"),
        F.round(T.bounded_float(F.col("value").cast("string")), 3).alias("bounded"),
        T.fence(F.concat(F.lit("a"), F.repeat(F.lit("`"), (i % 6).cast("int")), F.lit("b"))).alias("fence"),
    )
