"""Fact rules over configuration that tables stand in for: each rule on rows that it hits and rows that it does not (§2.14, FUN35)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import facts, stacks
from millrace.plans.registry import query
from millrace.sources.tables import table

_SHA = "0123456789" * 4
_USES = ("./local", "a/b@v1", f"a/b@{_SHA}", "docker://x", "actions/cache@v4", "a/b")


def _pick(values, k: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"""
WITH j AS (SELECT p_partkey AS k, '.github/workflows/' || CASE WHEN p_size % 3 = 0 THEN 'release' ELSE 'ci' END || p_partkey || '.yml' AS file, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END AS gap, {_list(_USES)}[CAST(p_partkey % 6 + 1 AS INTEGER)] AS uses FROM part)
SELECT file, 'ci.no-timeout' AS rule, CAST(NULL AS INTEGER) AS line, 'job build has no timeout-minutes' AS note, 2 AS severity FROM j WHERE k % 2 = 1
UNION ALL SELECT file, 'ci.no-permissions', NULL, 'job build has no permissions block', gap FROM j WHERE k % 3 <> 0 AND k % 5 <> 0
UNION ALL SELECT file, 'ci.continue-on-error', NULL, 'job build continues on error', 2 FROM j WHERE k % 7 = 0
UNION ALL SELECT file, 'ci.mutable-runner', NULL, 'job build runs on the mutable label ubuntu-latest', 2 FROM j WHERE k % 4 = 0
UNION ALL SELECT file, 'ci.no-cache', NULL, 'job build has no cache step', 2 FROM j WHERE k % 6 <> 4 AND k % 13 <> 0
UNION ALL SELECT file, 'ci.unpinned-action', NULL, uses || ' is not pinned to a commit SHA', gap FROM j WHERE k % 6 IN (1, 4, 5)
UNION ALL SELECT file, 'ci.commented-job', 2, 'commented-out job block', 2 FROM j WHERE k % 11 IN (0, 1)""")
def fact_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven rules of CI jobs (§2.14 ci, FUN35)."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(".github/workflows/"), F.when(F.col("p_size") % 3 == 0, "release").otherwise("ci"), k.cast("string"), F.lit(".yml")).alias("file"))
    step = F.struct(_pick(_USES, k).alias("uses"), F.when(k % 13 == 0, F.create_map(F.lit("cache"), F.lit("pip"))).alias("with"))
    job = F.struct(
        F.when(k % 4 == 0, "ubuntu-latest").otherwise("ubuntu-22.04").alias("runs-on"), F.when(k % 2 == 0, 5).alias("timeout-minutes"), F.when(k % 3 == 0, F.create_map(F.lit("contents"), F.lit("read"))).alias("permissions"),
        F.when(k % 7 == 0, True).alias("continue-on-error"), F.array(step).alias("steps"),
    )
    docs = p.select("file", F.to_json(F.struct(F.when(k % 5 == 0, "read-all").alias("permissions"), F.create_map(F.lit("build"), job).alias("jobs"))).alias("doc"))
    text = F.array(F.lit("jobs:"), F.when(k % 11 == 0, "  # runs-on: x").when(k % 11 == 1, "#steps :").otherwise("  # runs on x"), F.when(k % 11 == 0, "# steps:").otherwise("x"))
    lines = p.select("file", F.posexplode(text).alias("n", "line")).select("file", (F.col("n") + 1).alias("lineno"), "line")
    return facts.workflow_rules(docs).unionByName(facts.commented_jobs(lines)).select("file", "rule", "line", "note", "severity")


_DOCKER = (
    "FROM node AS build", "RUN apt-get install curl", "RUN curl x | sh", "ADD a b", "FROM build", "FROM python:3.12@sha256:x", "USER me", "SHELL [\"bash\", \"-o\", \"pipefail\", \"-c\"]",
    "# USER root", "RUN pip install -r requirements.txt", "ADD https://x/y z", "add x.tar.gz /", "FROM scratch", "FROM r.io:5000/app:latest", "  RUN apk add git@2", "FROM $BASE",
)


@query(f"""
WITH d AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN '.devcontainer/' ELSE '' END || 'o' || l_orderkey || '/Dockerfile' AS file, l_linenumber * 100000 + l_partkey AS n, trim({_list(_DOCKER)}[CAST(l_partkey % {len(_DOCKER)} + 1 AS INTEGER)], ' ') AS line FROM lineitem),
s AS (SELECT *, coalesce(bool_or(line LIKE 'SHELL %') OVER w, false) AS pipefail, coalesce(bool_or(line = 'FROM node AS build') OVER w, false) AS staged FROM d WINDOW w AS (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT file, 'container.untagged-base' AS rule, n AS line, 'base image ' || string_split(line, ' ')[2] || ' is untagged or latest' AS note FROM s WHERE line IN ('FROM node AS build', 'FROM r.io:5000/app:latest') OR (line = 'FROM build' AND NOT staged)
 UNION ALL SELECT file, 'container.unversioned-install', n, 'package install without a version pin' FROM s WHERE line = 'RUN apt-get install curl'
 UNION ALL SELECT file, 'container.no-pipefail', n, 'piped RUN without pipefail' FROM s WHERE line = 'RUN curl x | sh' AND NOT pipefail
 UNION ALL SELECT file, 'container.add-local', n, 'ADD used for a local file; COPY is explicit' FROM s WHERE line = 'ADD a b'
 UNION ALL SELECT file, 'container.no-user', min(n) FILTER (WHERE line LIKE 'FROM %'), 'no USER instruction; the container runs as root' FROM s GROUP BY file HAVING bool_or(line LIKE 'FROM %') AND NOT bool_or(line = 'USER me'))
SELECT file, rule, CAST(line AS INTEGER) AS line, note, CASE WHEN file LIKE '.devcontainer/%' THEN 1 ELSE 2 END AS severity FROM h""")
def fact_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rules of Dockerfiles, an order's lines each a file (§2.14 container, FUN35, SRC22)."""
    file = F.concat(F.when(F.col("l_orderkey") % 5 == 0, ".devcontainer/").otherwise(""), F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("/Dockerfile"))
    l = table(spark, sf_dir, "lineitem").select(file.alias("file"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("lineno"), _pick(_DOCKER, F.col("l_partkey")).alias("line"))
    return facts.container_rules(l).select("file", "rule", "line", "note", "severity")


_IMAGES = ("  image: nginx", "- image: 'a/b:1'", "image: \"r:5000/x\"", "images: y", "    image: z:latest", "image: q@sha256:1", "image: ${TAG}")


@query(f"""
WITH d AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'docker-compose.dev.yml' ELSE 'docker-compose.yml' END AS base, 's' || s_suppkey AS dir, s_suppkey, s_nationkey, {_list(_IMAGES)}[CAST(s_suppkey % {len(_IMAGES)} + 1 AS INTEGER)] AS line FROM supplier)
SELECT dir || '/' || base AS file, 'container.latest-image' AS rule, CAST(s_nationkey AS INTEGER) AS line, 'image ' || CASE s_suppkey % 7 WHEN 0 THEN 'nginx' WHEN 2 THEN 'r:5000/x' ELSE 'z:latest' END || ' is untagged or latest' AS note, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 2 END AS severity
FROM d WHERE s_suppkey % 7 IN (0, 2, 4)""")
def fact_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without a fixed tag in compose files (§2.14 container.latest-image)."""
    k = F.col("s_suppkey")
    file = F.concat(F.lit("s"), k.cast("string"), F.lit("/"), F.when(k % 4 == 0, "docker-compose.dev.yml").otherwise("docker-compose.yml"))
    l = table(spark, sf_dir, "supplier").select(file.alias("file"), F.col("s_nationkey").alias("lineno"), _pick(_IMAGES, k).alias("line"))
    return facts.image_rules(l).select("file", "rule", "line", "note", "severity")


@query("""
WITH c AS (SELECT p_partkey AS k, 'p' || p_partkey || '.yml' AS file FROM part)
SELECT file, 'iac.no-resource-limits' AS rule, 'container c' || k || ' has no resources.limits' AS note, 2 AS severity FROM c WHERE k % 2 = 1
UNION ALL SELECT file, 'iac.latest-image', 'container c' || k || ' uses ' || CASE k % 4 WHEN 0 THEN 'a/b' ELSE 'a:latest' END, 2 FROM c WHERE k % 4 IN (0, 1)
UNION ALL SELECT file, 'iac.privileged', 'container c' || k || ' is privileged', 2 FROM c WHERE k % 3 = 0""")
def fact_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rules of deployments (§2.14 iac, FUN35)."""
    k = F.col("p_partkey")
    limits = F.when(k % 2 == 0, F.struct(F.create_map(F.lit("cpu"), F.lit("1")).alias("limits")))
    pod = F.struct(F.concat(F.lit("c"), k.cast("string")).alias("name"), _pick(("a/b", "a:latest", "a:1", "a@sha256:x"), k).alias("image"), limits.alias("resources"), F.struct((k % 3 == 0).alias("privileged")).alias("securityContext"))
    spec = F.struct(F.struct(F.struct(F.array(pod).alias("containers")).alias("spec")).alias("template"))
    d = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string"), F.lit(".yml")).alias("file"), F.to_json(F.struct(F.lit("Deployment").alias("kind"), spec.alias("spec"))).alias("doc"))
    return facts.deployment_rules(d).select("file", "rule", "note", "severity")


_MANIFESTS = ("package.json", "pyproject.toml", "go.mod", "a.csproj", "build.gradle.kts", "README.md", "yarn.lock", "package-lock.json", "uv.lock", "go.sum")


@query(f"""
WITH f AS (SELECT DISTINCT 'c' || o_custkey AS dir, {_list(_MANIFESTS)}[CAST(o_orderkey // 4 % {len(_MANIFESTS)} + 1 AS INTEGER)] AS base FROM orders),
l(manifest, lock, pos) AS (VALUES ('package.json', 'package-lock.json', 1), ('package.json', 'yarn.lock', 2), ('package.json', 'pnpm-lock.yaml', 3), ('package.json', 'npm-shrinkwrap.json', 4), ('pyproject.toml', 'poetry.lock', 1), ('pyproject.toml', 'uv.lock', 2), ('pyproject.toml', 'pdm.lock', 3), ('go.mod', 'go.sum', 1), ('a.csproj', 'packages.lock.json', 1), ('build.gradle.kts', 'gradle.lockfile', 1)),
g AS (SELECT m.dir, m.base, string_agg(l.lock, ', ' ORDER BY pos) AS wanted, count(h.base) AS n, string_agg(h.base, ', ' ORDER BY pos) AS present FROM f m JOIN l ON l.manifest = m.base LEFT JOIN f h ON h.dir = m.dir AND h.base = l.lock GROUP BY 1, 2)
SELECT dir || '/' || base AS file, CASE WHEN n = 0 THEN 'manifest.no-lockfile' ELSE 'manifest.two-lockfiles' END AS rule, 1 AS line, CASE WHEN n = 0 THEN 'no lockfile (' || wanted || ') beside ' || base ELSE 'two lockfile kinds beside ' || base || ': ' || present END AS note, 2 AS severity FROM g WHERE n <> 1""")
def fact_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests without a lockfile or with two kinds, a customer's orders each a file (§2.14 manifest, JON27)."""
    o = table(spark, sf_dir, "orders")
    f = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/"), _pick(_MANIFESTS, F.floor(F.col("o_orderkey") / 4))).alias("file")).distinct()
    return facts.manifest_rules(f).select("file", "rule", "line", "note", "severity")


_BRANCHES = ("main", "release/1", "prod", "feature-x", "hotfix/2", "staging2", "master")


@query(f"""
WITH o AS (SELECT o_custkey AS repo, 'v' || o_orderkey AS name, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 AS ts FROM orders),
g AS (SELECT repo, name, lead(name) OVER w AS next, (lead(ts) OVER w - ts) // 86400 AS gap, row_number() OVER w AS pos FROM o WINDOW w AS (PARTITION BY repo ORDER BY ts, name)),
t AS (SELECT repo, count(*) AS n, median(gap) AS usual, max(gap) AS longest FROM g GROUP BY 1),
x AS (SELECT g.repo, name, next, row_number() OVER (PARTITION BY g.repo ORDER BY pos) AS rn FROM g JOIN t ON t.repo = g.repo AND gap = longest WHERE n >= 5 AND usual > 0 AND longest > 4 * usual),
b AS (SELECT s_nationkey AS repo, {_list(_BRANCHES)}[CAST(s_suppkey % {len(_BRANCHES)} + 1 AS INTEGER)] AS name FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 200 >= 90)
SELECT CAST(repo AS BIGINT) AS repo, 'release.tag-cadence' AS rule, 'irregular release cadence (' || name || ' to ' || next || ')' AS note, 2 AS severity FROM x WHERE rn = 1
UNION ALL SELECT repo, 'release.stale-env-branch', 'long-lived environment branch', 2 FROM b WHERE name IN ('release/1', 'prod', 'hotfix/2')
UNION ALL SELECT repo, 'ownership.stale-branches', 'branch hygiene', 2 FROM b WHERE name NOT IN ('main', 'master') GROUP BY repo HAVING count(*) > 10""")
def fact_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uneven tags and stale branches (§2.14 release and ownership.stale-branches, AGG08, SRC06)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("repo"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    now, k = F.lit("2024-06-01").cast("timestamp"), F.col("s_suppkey")
    b = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("long").alias("repo"), _pick(_BRANCHES, k).alias("name"), F.when(k % 5 == 0, "refs/remotes/o/x").otherwise("refs/heads/x").alias("ref"), (k % 3 == 0).alias("merged"),
        F.date_sub(F.lit("2024-06-01").cast("date"), (k % 200).cast("int")).cast("timestamp").alias("last_commit"),
    )
    return facts.release_rules(o, b, now).select("repo", "rule", "note", "severity")


_PATHS = ("a.py", "docs/CODEOWNERS", "docs/adr/1.md", "b.py", ".github/PULL_REQUEST_TEMPLATE.md", "madr/x", "c.py", "CODEOWNERS.md", "d.py", "e.py", "f.py")


@query(f"""
WITH f AS (SELECT s_nationkey % 25 * 7 + s_suppkey % 7 AS repo, {_list(_PATHS)}[CAST(s_suppkey % {len(_PATHS)} + 1 AS INTEGER)] AS path FROM supplier), r AS (SELECT DISTINCT repo FROM f),
h AS (SELECT repo, bool_or(path = 'docs/CODEOWNERS') AS owners, bool_or(path IN ('docs/adr/1.md', '.github/PULL_REQUEST_TEMPLATE.md')) AS process FROM f GROUP BY 1)
SELECT repo, 'ownership.no-codeowners' AS rule, 'no ownership map' AS note, 2 AS severity FROM h WHERE NOT owners
UNION ALL SELECT repo, 'ownership.no-adr-no-pr-template', 'decision and review process', 1 FROM h WHERE NOT process""")
def fact_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing owner maps, decision records and request templates (§2.14 ownership)."""
    k = F.col("s_suppkey")
    f = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 25 * 7 + k % 7).alias("repo"), _pick(_PATHS, k).alias("path"))
    return facts.process_rules(f, f).select("repo", "rule", "note", "severity")


@query("""
WITH h AS (SELECT 'src/p' || p_partkey || '.py' AS file, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, (p_partkey % 100) / 100.0::DOUBLE AS share, DATE '2024-06-01' - CAST(p_size * 8 AS INTEGER) AS seen FROM part)
SELECT file, 'ownership.knowledge-island' AS rule, 'knowledge island on a hotspot-band file' AS note, CASE WHEN rank <= 5 THEN 4 ELSE 3 END AS severity FROM h WHERE share >= 0.8
UNION ALL SELECT file, 'ownership.former-contributor', 'hotspot whose top author is inactive', 2 FROM h WHERE DATE '2024-06-01' - seen > 180
UNION ALL SELECT file, 'ownership.unowned-hotspot', 'matches no ownership rule', 2 FROM h WHERE NOT regexp_matches(file, '^src/p1[^/]*$')""")
def fact_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge islands, inactive authors and unowned files (§2.14 ownership, JON28, JON40)."""
    from millrace.operators.windows import numbered

    p = numbered(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], "rank")
    day = F.lit("2024-06-01").cast("date")
    h = p.select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"), "rank", F.lit("x").alias("top_author"), ((F.col("p_partkey") % 100) / 100.0).alias("share"), F.date_sub(day, (F.col("p_size") * 8).cast("int")).alias("last_active"))
    return facts.ownership_rules(h, ["src/p1*"], day).select("file", "rule", "note", "severity")


_CODE = (
    "@GetMapping(\"/a\")", "@JmsListener(destination = \"q\")", "repo.save(x)", "jms.convertAndSend(q, m)", "restTemplate.get(u)", "@NotNull String s", "@POST", "@Incoming(\"in\")", "e.persist(x)", "@Outgoing(\"o\")", "Client.create (u)", "[HttpGet(\"b\")]",
    "GetQueue(\"r\")", "db.SaveChangesAsync()", "bus.Publish(x)", "c.GetAsync(u)", "[Required]", "@app.get('/c')", "create_receiver(ns, 't')", "session.add(x)", "bus.publish (m)", "httpx.get(u)", "Field(gt=1)", "plain line", "unsaved(x)", "GetMapping",
)


@query(f"""
WITH l AS (SELECT p_partkey, {_list(_CODE)}[CAST(p_partkey % {len(_CODE)} + 1 AS INTEGER)] AS line FROM part),
m(stack, kind, pattern) AS (VALUES ('spring', 'entry-http', '@(Get|Post|Put|Delete|Patch)Mapping\\b'), ('spring', 'entry-amq', '@JmsListener\\s*\\(\\s*destination\\s*=\\s*"[^"]+"'), ('spring', 'db-write', '\\.(save|saveAll|persist|merge|remove)\\s*\\('), ('spring', 'amq-publish', '\\.(convertAndSend|send)\\s*\\('), ('spring', 'http-out', 'restTemplate\\.'), ('spring', 'validation', '@NotNull\\b'),
 ('quarkus', 'entry-http', '@(GET|POST)\\b'), ('quarkus', 'entry-amq', '@Incoming\\s*\\('), ('quarkus', 'db-write', '\\.(persist|merge|remove)\\s*\\('), ('quarkus', 'amq-publish', '\\.send\\s*\\(|@Outgoing\\s*\\('), ('quarkus', 'http-out', 'Client\\.\\w+\\s*\\('), ('quarkus', 'validation', '@NotNull\\b'),
 ('aspnetcore', 'entry-http', '\\[Http(Get|Post)'), ('aspnetcore', 'entry-amq', 'GetQueue\\s*\\('), ('aspnetcore', 'db-write', 'SaveChanges(Async)?\\s*\\('), ('aspnetcore', 'amq-publish', '\\.(Send|Publish)(Async)?\\s*\\('), ('aspnetcore', 'http-out', '\\.GetAsync\\s*[<(]'), ('aspnetcore', 'validation', '\\[Required\\b'),
 ('python', 'entry-http', '@\\w+\\.get\\s*\\('), ('python', 'entry-amq', 'create_receiver\\s*\\([^,]+,'), ('python', 'db-write', 'session\\.add\\s*\\('), ('python', 'amq-publish', '\\.(send|publish)\\s*\\('), ('python', 'http-out', '\\b(httpx|requests|aiohttp)\\.'), ('python', 'validation', '\\bField\\s*\\('))
SELECT stack, kind, line, CAST(count(*) AS BIGINT) AS n FROM l JOIN m ON regexp_matches(line, pattern) GROUP BY ALL""")
def stack_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines say of four stacks in six kinds (§2.15)."""
    l = table(spark, sf_dir, "part").select(_pick(_CODE, F.col("p_partkey")).alias("line"))
    return stacks.marked(l).groupBy("stack", "kind", "line").agg(F.count("*").alias("n"))
