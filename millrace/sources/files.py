"""File sources and sinks: trees, logs, diffs, blame, refs, JSON, CSV, and text reports.

Every reader is a Spark source and Column expressions, so any store that Spark reads will
do; parsers take a DataFrame with the text, which tests feed literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

LARGE, HEAD = 2_000_000, 1024


def scan_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``path, length, content`` of every file below ``root``, paths relative to it (SRC01, SRC32)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    rel = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/" if root.split(":", 1)[-1].strip("/") else "/"
    return r.load(root).select(F.substr(rel, F.instr(rel, F.lit(base)) + len(base)).alias("path"), "length", "modificationTime", "content")


def decoded(files: DataFrame) -> DataFrame:
    """``text`` with bad bytes replaced; null and ``skipped`` where a file is large or has a NUL early (SRC02, SRC04)."""
    skip = (F.col("length") > LARGE) | F.contains(F.substring("content", 1, HEAD), F.lit(b"\0"))
    return files.withColumn("skipped", skip).withColumn("text", F.when(~skip, F.decode("content", "UTF-8"))).drop("content")


def heads(files: DataFrame, marks: dict[str, str], limit: int = 65_536) -> DataFrame:
    """Which of some marks stand in the first bytes of a file (SRC31): a boolean column for each."""
    head = F.substring("text", 1, limit)
    return files.select("path", *[F.coalesce(F.contains(head, F.lit(v)), F.lit(False)).alias(k) for k, v in marks.items()])


def commits(log: DataFrame) -> DataFrame:
    """``sha, author, email, ts, subject, files, pos`` from log text in ``value``: records between 0x1e, a header of five
    tab-separated fields, then a path a line (SRC05). ``pos`` numbers commits in log order within a text.
    """
    r = log.select(F.posexplode(F.split("value", "\x1e")).alias("pos", "rec")).where("trim(rec) <> ''")
    lines = F.filter(F.split("rec", "\n"), lambda x: x != "")
    head = F.split(F.element_at(lines, 1), "\t", 5)
    field = lambda i: F.get(head, F.lit(i))
    return r.select(
        field(0).alias("sha"), field(1).alias("author"), field(2).alias("email"), F.try_to_timestamp(field(3)).alias("ts"), field(4).alias("subject"), F.slice(lines, F.lit(2), F.size(lines)).alias("files"), "pos"
    )


def refs(listing: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """``name, ts, merged`` from ``name<TAB>date<TAB>symref`` lines; symbolic refs go; merged is null when unknown (SRC06)."""
    f = F.split("value", "\t")
    out = listing.select(F.get(f, F.lit(0)).alias("name"), F.try_to_timestamp(F.get(f, F.lit(1))).alias("ts"), F.get(f, F.lit(2)).alias("_s"))
    out = out.where("coalesce(_s, '') = ''").drop("_s")
    if merged is None:
        return out.withColumn("merged", F.lit(None).cast("boolean"))
    m = merged.select(F.col("name").alias("_m")).distinct()
    return out.join(m, F.col("name") == F.col("_m"), "left").select("name", "ts", F.col("_m").isNotNull().alias("merged"))


def blame(lines: DataFrame) -> DataFrame:
    """``file, line, sha, author, epoch`` from line-porcelain text ``(file, n, value)`` (SRC07).

    Attributes belong to the last header above them; a line of content starts with a tab.
    """
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda regex, g: F.last(F.nullif(F.regexp_extract("value", regex, g), F.lit("")), ignorenulls=True).over(w)
    header = r"^([0-9a-f]{40}) [0-9]+ ([0-9]+)"
    out = lines.select("file", "n", "value", last(header, 1).alias("sha"), last(header, 2).cast("int").alias("line"), last("^author (.*)$", 1).alias("author"), last("^author-time ([0-9]+)$", 1).cast("long").alias("epoch"))
    return out.where(F.startswith("value", F.lit("\t"))).select("file", "line", "sha", "author", "epoch")


def hunks(lines: DataFrame) -> DataFrame:
    """``file, old_start, old_end, new_start, new_end, text`` from unified diffs ``(id, n, value)`` (SRC08); a missing count is 1."""
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
    is_head = F.col("value").rlike(head)
    s = lines.withColumn("file", F.last(F.nullif(F.regexp_extract("value", r"^\+\+\+ b/(.*)$", 1), F.lit("")), ignorenulls=True).over(w)).withColumn("no", F.sum(is_head.cast("int")).over(w))
    s = s.where("no > 0").where(~F.col("value").rlike(r"^(diff --git|index |--- |\+\+\+ )"))
    num = lambda g: F.regexp_extract("value", head, g)
    count = lambda g: F.when(num(g) == "", 1).otherwise(num(g).try_cast("int"))
    first = s.where(is_head).select("id", "no", "file", num(1).cast("int").alias("old_start"), count(2).alias("old_n"), num(3).cast("int").alias("new_start"), count(4).alias("new_n"))
    body = s.where(~is_head).groupBy("id", "no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n").alias("text"))
    return first.join(body, ["id", "no"], "left").select("id", "file", "old_start", (F.col("old_start") + F.col("old_n") - 1).alias("old_end"), "new_start", (F.col("new_start") + F.col("new_n") - 1).alias("new_end"), F.coalesce("text", F.lit("")).alias("text"))


def trailers(messages: DataFrame, key: str) -> DataFrame:
    """``sha, value`` of commit messages that carry a trailer (SRC10)."""
    v = F.regexp_extract("message", rf"(?m)^{key}: (\S+)\s*$", 1)
    return messages.select("sha", v.alias("value")).where("value <> ''")


def index_listing(listing: DataFrame) -> DataFrame:
    """``path, kind`` (file, link, module) from an index listing with mode bits (SRC17)."""
    mode, path = F.substring("value", 1, 6), F.regexp_extract("value", "\t(.*)$", 1)
    return listing.select(path.alias("path"), F.when(mode == "160000", "module").when(mode == "120000", "link").otherwise("file").alias("kind")).where("path <> ''")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, replaced whole (SRC11)."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    """JSON with a declared schema; a missing optional document is empty (SRC12)."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_yaml(spark: SparkSession, texts: list[str], schema: str) -> DataFrame:
    """Documents of YAML texts, parsed on the driver (configuration is small); needs PyYAML (SRC13)."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    docs = [d for t in texts for d in yaml.safe_load_all(t) if d is not None]
    import json

    return spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string").select(F.from_json("doc", schema).alias("d")).select("d.*")


def read_rules(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV whose header must be exactly the columns; all strings (SRC14)."""
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON log (SRC26)."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str, order: str) -> DataFrame:
    """The log with 1-based iteration numbers (SRC26)."""
    from millrace.operators.windows import numbered

    return numbered(spark.read.schema(schema).json(path), [F.asc(order)], "iteration")


def tail(lines: DataFrame, key: str, n: int, sources: DataFrame | None = None, instead: str = "") -> DataFrame:
    """The last n lines of each text as one; with ``sources(key)`` a row for each of them, ``instead`` where one is empty (SRC35)."""
    last = lines.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("lineno")))).where(F.col("_r") <= n)
    out = last.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]), "\n").alias("tail"))
    return out if sources is None else sources.select(key).distinct().join(out, key, "left").withColumn("tail", F.coalesce("tail", F.lit(instead)))


def document(df: DataFrame, order: list[str]) -> DataFrame:
    """One JSON text of all rows in order, indented, keys sorted (SRC11). A document is read whole by its reader, so the rows are few."""
    row = F.struct(*[F.col(c) for c in sorted(df.columns)])
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), row.alias("r")))), lambda x: x["r"])
    return df.agg(F.to_json(rows, {"pretty": "true"}).alias("document"))


def deployments(manifests: DataFrame) -> DataFrame:
    """``path, name, image, port, ready, env`` of the first container of deployments ``(path, doc)`` (SRC22)."""
    c = "struct<name string, image string, ports array<struct<containerPort int>>, readinessProbe struct<httpGet struct<path string>>, env array<struct<name string>>, envFrom array<struct<configMapRef struct<name string>>>>"
    d = F.from_json("doc", f"struct<spec struct<template struct<spec struct<containers array<{c}>>>>>")["spec"]["template"]["spec"]["containers"]
    one = manifests.select("path", F.get(d, F.lit(0)).alias("c")).where("c is not null")
    names = lambda a, get: F.coalesce(F.transform(a, get), F.array().cast("array<string>"))
    env = F.concat(names(F.col("c.env"), lambda e: e["name"]), names(F.col("c.envFrom"), lambda e: e["configMapRef"]["name"]))
    return one.select("path", "c.name", "c.image", F.get("c.ports", F.lit(0))["containerPort"].alias("port"), F.col("c.readinessProbe.httpGet.path").alias("ready"), F.array_sort(env).alias("env"))


def flattened(settings: DataFrame, sources: dict[str, int]) -> DataFrame:
    """``key, value, source`` of flat settings ``(source, key, value)``; the first source by rank wins (SRC21)."""
    rank = F.create_map(*[F.lit(x) for kv in sources.items() for x in kv])
    s = settings.withColumn("_r", rank[F.col("source")])
    best = s.groupBy("key").agg(F.min_by(F.struct("value", "source"), F.struct("_r", "source", "value")).alias("b"))
    return best.select("key", "b.value", "b.source")


def make_targets(lines: DataFrame) -> DataFrame:
    """``path, target`` declared in Makefile lines ``(path, lineno, line)``; pattern and dot targets are left out (SRC29)."""
    names = F.split(F.regexp_extract("line", r"^([A-Za-z0-9_./ -]+?)\s*:(?!=)", 1), r"\s+")
    t = lines.select("path", F.explode(names).alias("target"))
    return t.where("target <> '' and not startswith(target, '.') and not contains(target, '%')").distinct()


def script_names(manifests: DataFrame) -> DataFrame:
    """``path, target, command`` of the scripts in package manifests ``(path, text)`` (SRC29)."""
    return manifests.select("path", F.explode(F.from_json("text", "scripts map<string,string>")["scripts"]).alias("target", "command"))


def dockerfile(lines: DataFrame) -> DataFrame:
    """One row of a Dockerfile's facts ``(path, lineno, line)``: last base image, ports, user, workdir (SRC22)."""
    arg = lambda word: F.nullif(F.regexp_extract("line", rf"(?i)^\s*{word}\s+(\S+)", 1), F.lit(""))
    v = lines.select("path", "lineno", arg("FROM").alias("base"), arg("EXPOSE").alias("port"), arg("USER").alias("user"), arg("WORKDIR").alias("workdir"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("lineno"))).alias(c)
    return v.groupBy("path").agg(last("base"), F.array_sort(F.collect_set("port")).alias("ports"), last("user"), last("workdir"))


def routes(lines: DataFrame) -> DataFrame:
    """``path, lineno, method, route`` with a class-level prefix carried to the methods below it (SRC23)."""
    w = Window.partitionBy("path").orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    get = lambda regex, g: F.nullif(F.regexp_extract("line", regex, g), F.lit(""))
    prefix = F.last(get(r"@RequestMapping\(\s*\"([^\"]+)\"", 1), ignorenulls=True).over(w)
    method = F.coalesce(get(r"@(Get|Post|Put|Delete|Patch)Mapping\b", 1), get(r"\b(?:app|router)\.(get|post|put|delete|patch)\(", 1))
    own = F.coalesce(get(r"@(?:Get|Post|Put|Delete|Patch)Mapping\(\s*\"([^\"]*)\"", 1), get(r"\b(?:app|router)\.(?:get|post|put|delete|patch)\(\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
    return lines.select("path", "lineno", F.upper(method).alias("method"), T.joined_route(F.coalesce(prefix, F.lit("")), own).alias("route")).where("method is not null")


def at_snapshot(tree: DataFrame, snapshot: str) -> DataFrame:
    """``path, content`` of one snapshot of a table partitioned by it (SRC09): the filter prunes the other partitions."""
    return tree.where(F.col("snapshot") == snapshot).drop("snapshot")


def artefacts(files: DataFrame, classes: list[tuple[str, str]]) -> DataFrame:
    """``path, class`` and class-specific columns, null elsewhere: cells of notebooks, pointers to large files (SRC30)."""
    from millrace.operators.classify import first_match

    c = first_match(F.col("path"), classes, "other")
    pointer = F.startswith("text", F.lit("version https://git-lfs"))
    cells = F.size(F.from_json("text", "cells array<struct<cell_type string>>")["cells"])
    out = files.withColumn("class", c).where("class <> 'other'")
    return out.select("path", "class", F.when(F.col("class") == "large", pointer).alias("pointer"), F.when(F.col("class") == "notebook", cells).alias("n_cells"))


def environment(manifest: DataFrame, image: DataFrame, config: DataFrame) -> DataFrame:
    """``name, value, source``: settings by environment name; the manifest wins over the image, the image over the configuration (SRC36, EXT08)."""
    part = lambda df, rank, source: df.select(T.env_name(F.col("name")).alias("name"), "value", F.lit(source).alias("source"), F.lit(rank).alias("_r"))
    every = part(manifest, 0, "manifest").unionByName(part(image, 1, "image")).unionByName(part(config, 2, "config"))
    best = every.groupBy("name").agg(F.min_by(F.struct("value", "source"), F.struct("_r", "value")).alias("b"))
    return best.select("name", "b.value", "b.source")
