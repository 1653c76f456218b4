"""Deterministic fact rules over structured configuration: ``rule, file, line, note, severity``.

Workflows and manifests come as JSON text (YAML is converted on the way in), Dockerfiles as
lines. Rule ids, notes and severities are fixed values. Each rule is one predicate; hits of a file are collapsed by ``aggregates.collapse_hits``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.normalise import union_all

STEP = "struct<uses string, run string, name string, `with` map<string,string>>"
JOB = f"struct<`runs-on` string, `timeout-minutes` int, permissions string, `continue-on-error` string, steps array<{STEP}>>"
POD = "struct<name string, image string, resources struct<limits map<string,string>>, securityContext struct<privileged boolean>>"
#: Names of releases and of environment branches, default branches, files for development, installs without a version, archives.
RELEASE, ENVIRONMENT, DEFAULT = "(?i)release|publish|deploy", "^(?:hotfix|release)/|^(?:prod|staging)$", ("main", "master")
DEV_ONLY = ("docker-compose.dev.yml", "docker-compose.dev.yaml")
UNVERSIONED = r"\b(?:apt-get\s+install|apt\s+install|apk\s+add|pip3?\s+install|gem\s+install)\b(?![^|&;]*(?:==|=\d|@\d|-r\s|--requirement|\.txt))"
ARCHIVES = (".tar", ".gz", ".tgz", ".bz2", ".xz", ".zip")


def _hit(df: DataFrame, rule: str, when: Column, note: Column, severity: int | Column, line: Column | None = None) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, int) else severity
    return df.where(when).select(F.lit(rule).alias("rule"), "file", (line if line is not None else F.lit(None)).cast("int").alias("line"), note.alias("note"), severity.alias("severity"))


def is_latest(image: Column) -> Column:
    """Whether an image has no tag or the tag ``latest``; digests and variables have neither."""
    tail = F.regexp_extract(image, "([^/]*)$", 1)
    return (image != "") & ~F.contains(image, F.lit("@")) & ~F.startswith(image, F.lit("$")) & (~F.contains(tail, F.lit(":")) | F.endswith(image, F.lit(":latest")))


def workflow_rules(workflows: DataFrame) -> DataFrame:
    """Rules on CI jobs from ``(file, doc)``: timeouts, permissions, runners, pins and caches. Gaps of releases weigh 3."""
    w = workflows.select("file", F.from_json("doc", f"struct<permissions string, jobs map<string,{JOB}>>").alias("d"))
    j = w.select("file", F.col("d.permissions").alias("wide"), F.explode("d.jobs").alias("name", "job"))
    j = j.withColumn("gap", F.when(F.col("name").rlike(RELEASE) | F.regexp_extract("file", "([^/]*)$", 1).rlike(RELEASE), 3).otherwise(2))
    says = lambda text: F.concat(F.lit("job "), "name", F.lit(" " + text))
    runner = F.col("job.runs-on")
    caches = lambda s: F.coalesce(F.contains(s["uses"], F.lit("actions/cache")), F.lit(False)) | F.coalesce(F.map_contains_key(s["with"], "cache"), F.lit(False))
    cached = F.exists(F.coalesce("job.steps", F.array().cast(f"array<{STEP}>")), caches)
    steps = j.select("file", "name", "gap", F.explode("job.steps").alias("step")).withColumn("uses", F.col("step.uses"))
    loose = F.col("uses").isNotNull() & ~F.startswith("uses", F.lit("./")) & ~F.startswith("uses", F.lit("docker://")) & ~F.col("uses").rlike("@[0-9a-f]{40}$")
    return union_all([
        _hit(j, "ci.no-timeout", F.col("job.timeout-minutes").isNull(), says("has no timeout-minutes"), 2),
        _hit(j, "ci.no-permissions", F.col("job.permissions").isNull() & F.col("wide").isNull(), says("has no permissions block"), F.col("gap")),
        _hit(j, "ci.continue-on-error", F.lower(F.coalesce("job.continue-on-error", F.lit(""))) == "true", says("continues on error"), 2),
        _hit(j, "ci.mutable-runner", F.coalesce(runner.rlike("-latest$"), F.lit(False)), F.concat(says("runs on the mutable label "), runner), 2),
        _hit(j, "ci.no-cache", ~cached, says("has no cache step"), 2),
        _hit(steps, "ci.unpinned-action", loose, F.concat("uses", F.lit(" is not pinned to a commit SHA")), F.col("gap")),
    ])


def commented_jobs(lines: DataFrame) -> DataFrame:
    """The first commented-out job line of each file ``(file, lineno, line)``."""
    first = lines.where(F.trim("line").rlike(r"^#\s*(?:runs-on|steps)\s*:")).groupBy("file").agg(F.min("lineno").alias("lineno"))
    return _hit(first, "ci.commented-job", F.lit(True), F.lit("commented-out job block"), 2, F.col("lineno"))


def container_rules(lines: DataFrame) -> DataFrame:
    """Rules on Dockerfile lines ``(file, lineno, line)``; stages and shells seen so far come from running windows."""
    w = Window.partitionBy("file").orderBy("lineno").rowsBetween(Window.unboundedPreceding, -1)
    own = lines.withColumn("line", F.trim(F.translate("line", "\t\r", "  "))).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    word = lambda n: F.startswith(F.upper("line"), F.lit(n + " "))
    part = lambda n: F.coalesce(F.get(F.split("line", r"\s+"), F.lit(n)), F.lit(""))
    stage = F.when(word("FROM") & (F.upper(part(2)) == "AS"), F.nullif(part(3), F.lit("")))
    # a stage may name the image of its own line
    d = own.withColumn("stages", F.array_union(F.coalesce(F.collect_set(stage).over(w), F.array().cast("array<string>")), F.array_compact(F.array(stage))))
    d = d.withColumn("pipefail", F.coalesce(F.bool_or(word("SHELL") & F.contains("line", F.lit("pipefail"))).over(w), F.lit(False)))
    image, source = part(1), part(1)
    base = word("FROM") & (image != "scratch") & ~F.array_contains("stages", image) & is_latest(image)
    local = ~F.startswith(source, F.lit("http://")) & ~F.startswith(source, F.lit("https://")) & ~reduce(lambda x, y: x | y, [F.endswith(source, F.lit(x)) for x in ARCHIVES])
    users = own.groupBy("file").agg(F.bool_or(word("USER")).alias("user"), F.min(F.when(word("FROM"), F.col("lineno"))).alias("lineno"))
    out = union_all([
        _hit(d, "container.untagged-base", base, F.concat(F.lit("base image "), image, F.lit(" is untagged or latest")), 2, F.col("lineno")),
        _hit(d, "container.unversioned-install", word("RUN") & F.col("line").rlike(UNVERSIONED), F.lit("package install without a version pin"), 2, F.col("lineno")),
        _hit(d, "container.no-pipefail", word("RUN") & F.contains("line", F.lit("|")) & ~F.col("pipefail"), F.lit("piped RUN without pipefail"), 2, F.col("lineno")),
        _hit(d, "container.add-local", word("ADD") & local, F.lit("ADD used for a local file; COPY is explicit"), 2, F.col("lineno")),
        _hit(users, "container.no-user", F.col("lineno").isNotNull() & ~F.col("user"), F.lit("no USER instruction; the container runs as root"), 2, F.col("lineno")),
    ])
    return _for_development(out)


def image_rules(lines: DataFrame) -> DataFrame:
    """Images without a fixed tag in lines ``(file, lineno, line)`` of compose files and the like."""
    image = F.regexp_extract("line", r"^\s*(?:-\s*)?[\"']?image[\"']?:\s*[\"']?([^\s\"']+)", 1)
    return _for_development(_hit(lines, "container.latest-image", is_latest(image), F.concat(F.lit("image "), image, F.lit(" is untagged or latest")), 2, F.col("lineno")))


def _for_development(hits: DataFrame) -> DataFrame:
    dev = F.regexp_extract("file", "([^/]*)$", 1).isin(*DEV_ONLY) | F.contains("file", F.lit(".devcontainer/"))
    return hits.withColumn("severity", F.when(dev, F.greatest(F.lit(1), F.col("severity") - 1)).otherwise(F.col("severity")))


def deployment_rules(manifests: DataFrame) -> DataFrame:
    """Rules on containers of deployments from ``(file, doc)``."""
    kind = f"struct<kind string, spec struct<template struct<spec struct<containers array<{POD}>>>>>"
    c = manifests.select("file", F.explode(F.from_json("doc", kind)["spec"]["template"]["spec"]["containers"]).alias("c")).select("file", "c.*")
    says = lambda *parts: F.concat(F.lit("container "), F.coalesce("name", F.lit("container")), *parts)
    image = F.coalesce("image", F.lit(""))
    return union_all([
        _hit(c, "iac.no-resource-limits", F.col("resources.limits").isNull(), says(F.lit(" has no resources.limits")), 2),
        _hit(c, "iac.latest-image", is_latest(image), says(F.lit(" uses "), image), 2),
        _hit(c, "iac.privileged", F.coalesce("securityContext.privileged", F.lit(False)), says(F.lit(" is privileged")), 2),
    ])


#: Lockfile kinds by manifest (a pattern of its name).
LOCKS = {
    r"package\.json": ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json"),
    r"pyproject\.toml": ("poetry.lock", "uv.lock", "pdm.lock"),
    r"go\.mod": ("go.sum",),
    r"Cargo\.toml": ("Cargo.lock",),
    r"Gemfile": ("Gemfile.lock",),
    r".*\.csproj": ("packages.lock.json",),
    r"build\.gradle.*": ("gradle.lockfile",),
}


def manifest_rules(files: DataFrame) -> DataFrame:
    """Manifests without a lockfile beside them, or with two kinds (JON27), from ``(file)``: one join on folder and kind."""
    named = files.select("file", F.regexp_extract("file", r"^(.*/)?([^/]+)$", 1).alias("dir"), F.regexp_extract("file", r"([^/]+)$", 1).alias("base"))
    kind = F.coalesce(*[F.when(F.col("base").rlike(f"^(?:{p})$"), F.lit(i)) for i, p in enumerate(LOCKS)])
    wanted = F.element_at(F.array(*[F.array(*map(F.lit, ks)) for ks in LOCKS.values()]), F.col("kind") + 1)
    m = named.withColumn("kind", kind).where("kind is not null").withColumn("locks", wanted)
    every = sorted({k for ks in LOCKS.values() for k in ks})
    have = named.where(F.col("base").isin(*every)).groupBy(F.col("dir").alias("_d")).agg(F.collect_set("base").alias("have"))
    g = m.join(have, F.col("dir") == F.col("_d"), "left").withColumn("present", F.array_intersect("locks", F.coalesce("have", F.array().cast("array<string>"))))
    return union_all([
        _hit(g, "manifest.no-lockfile", F.size("present") == 0, F.concat(F.lit("no lockfile ("), F.array_join("locks", ", "), F.lit(") beside "), "base"), 2, F.lit(1)),
        _hit(g, "manifest.two-lockfiles", F.size("present") > 1, F.concat(F.lit("two lockfile kinds beside "), "base", F.lit(": "), F.array_join("present", ", ")), 2, F.lit(1)),
    ])


def release_rules(tags: DataFrame, branches: DataFrame, now: Column, min_tags: int = 5, multiple: int = 4, stale_days: int = 90, most_stale: int = 10) -> DataFrame:
    """``repo`` and the columns of hits: uneven tags ``(repo, name, ts)``, stale branches ``(repo, name, ref, merged, last_commit)`` (AGG08).

    A branch counts if it is local, known to be unmerged and has a date.
    """
    w = Window.partitionBy("repo").orderBy("ts", "name")
    gap = F.floor((F.unix_seconds(F.lead("ts").over(w)) - F.unix_seconds("ts")) / 86_400)
    g = tags.where("ts is not null").select("repo", "name", "ts", gap.alias("gap"), F.lead("name").over(w).alias("next"), F.row_number().over(w).alias("at"))
    first = F.max_by(F.struct("name", "next"), F.when(F.col("gap").isNotNull(), F.struct("gap", (-F.col("at")).alias("at"))))
    t = g.groupBy("repo").agg(F.count("*").alias("n"), F.median("gap").alias("usual"), F.max("gap").alias("longest"), first.alias("f")).withColumn("file", F.lit(None).cast("string"))
    uneven = (F.col("n") >= min_tags) & (F.col("usual") > 0) & (F.col("longest") > multiple * F.col("usual"))
    age = F.floor((F.unix_seconds(now) - F.unix_seconds("last_commit")) / 86_400)
    b = branches.where(F.startswith("ref", F.lit("refs/heads/")) & ~F.col("merged") & F.col("last_commit").isNotNull()).withColumn("age", age).where(F.col("age") >= stale_days)
    b = b.withColumn("file", F.lit(None).cast("string"))
    many = b.where(~F.col("name").isin(*DEFAULT)).groupBy("repo").agg(F.count("*").alias("stale")).withColumn("file", F.lit(None).cast("string"))
    return union_all([
        _with_repo(t, "release.tag-cadence", uneven, F.concat(F.lit("irregular release cadence ("), "f.name", F.lit(" to "), "f.next", F.lit(")")), 2),
        _with_repo(b, "release.stale-env-branch", F.col("name").rlike(ENVIRONMENT), F.lit("long-lived environment branch"), 2),
        _with_repo(many, "ownership.stale-branches", F.col("stale") > most_stale, F.lit("branch hygiene"), 2),
    ])


def _with_repo(df: DataFrame, rule: str, when: Column, note: Column, severity: int) -> DataFrame:
    return df.where(when).select("repo", F.lit(rule).alias("rule"), "file", F.lit(None).cast("int").alias("line"), note.alias("note"), F.lit(severity).alias("severity"))


def process_rules(repos: DataFrame, files: DataFrame) -> DataFrame:
    """Repositories ``(repo)`` without an owner map, or without both decision records and a request template, by their files ``(repo, path)``."""
    base = F.regexp_extract("path", "([^/]*)$", 1)
    decisions = F.col("path").rlike("(^|/)adrs?/")
    has = files.groupBy("repo").agg(F.bool_or(base == "CODEOWNERS").alias("owners"), F.bool_or(decisions | F.startswith(base, F.lit("PULL_REQUEST_TEMPLATE"))).alias("process"))
    r = repos.select("repo").distinct().join(has, "repo", "left").withColumn("file", F.lit(None).cast("string"))
    return union_all([
        _with_repo(r, "ownership.no-codeowners", ~F.coalesce("owners", F.lit(False)), F.lit("no ownership map"), 2),
        _with_repo(r, "ownership.no-adr-no-pr-template", ~F.coalesce("process", F.lit(False)), F.lit("decision and review process"), 1),
    ])


def ownership_rules(hotspots: DataFrame, owners: list[str], today: Column, idle_days: int = 180) -> DataFrame:
    """Knowledge islands, inactive authors and unowned files among hotspots ``(file, rank, top_author, share, last_active)`` (JON40, JON28)."""
    from millrace.operators.classify import glob_regex

    h = hotspots
    island = F.col("share") >= 0.8
    unowned = ~F.col("file").rlike("|".join(map(glob_regex, owners))) if owners else F.lit(True)
    top = _hit(h, "ownership.knowledge-island", island, F.lit("knowledge island on a hotspot-band file"), 3).withColumn("severity", F.lit(3))
    first = _hit(h.where("rank <= 5"), "ownership.knowledge-island", island, F.lit("knowledge island on a hotspot-band file"), 4)
    return union_all([
        first,
        top.join(h.where("rank <= 5").select("file"), "file", "left_anti").select(*first.columns),
        _hit(h, "ownership.former-contributor", F.datediff(today, F.col("last_active")) > idle_days, F.lit("hotspot whose top author is inactive"), 2),
        _hit(h, "ownership.unowned-hotspot", unowned, F.lit("matches no ownership rule"), 2),
    ])
