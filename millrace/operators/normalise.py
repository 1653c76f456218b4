"""Tool payloads (nested JSON, CSV rows, text lines) into one flat ``signals`` schema.

``tool, family, kind, file, line_start, line_end, message, fact, extra`` with ``extra`` a
map of strings. Each function takes a DataFrame with the tool's output in ``payload`` and
declares only the fields it keeps, so parsing prunes the rest: secrets, matches, snippets
and duplicated source never become columns. Rows that cannot be used are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule codes, categories, levels and labels of the tools.
RUFF = {
    "E722": ("error-masking", "error-masking"),
    "BLE001": ("error-masking", "error-masking"),
    "S110": ("error-masking", "error-masking"),
    "S112": ("error-masking", "error-masking"),
    "C901": ("complex-units", "complexity"),
    "PLR0911": ("complex-units", "complexity"),
    "PLR0912": ("complex-units", "complexity"),
    "PLR0913": ("complex-units", "complexity"),
    "PLR0915": ("complex-units", "complexity"),
    "F401": ("dead-code", "unused"),
    "UP035": ("dependency-debt", "deprecated"),
    "PERF101": ("performance", "perf-smell"),
    "PERF102": ("performance", "perf-smell"),
    "PERF203": ("performance", "perf-smell"),
    "PERF401": ("performance", "perf-smell"),
    "PERF402": ("performance", "perf-smell"),
    "PERF403": ("performance", "perf-smell"),
}
KNIP = {
    "files": ("dead-code", "file"),
    "exports": ("dead-code", "export"),
    "types": ("dead-code", "type"),
    "enumMembers": ("dead-code", "enum member"),
    "namespaceMembers": ("dead-code", "namespace member"),
    "dependencies": ("dependency-debt", "dependency"),
    "devDependencies": ("dependency-debt", "devDependency"),
}
OSV_LABELS = {"CRITICAL": 5, "HIGH": 4, "MODERATE": 3, "MEDIUM": 3, "LOW": 2, "NEGLIGIBLE": 1}
HADOLINT_LEVELS = {"error": 4, "warning": 3, "info": 2, "style": 1}
KINDS = ("vuln", "secret", "clone", "cycle", "unused", "deprecated", "complexity", "error-masking", "dockerfile", "workflow", "perf-smell")
FAMILIES = ("complex-units", "dead-code", "dependency-debt", "duplication", "error-masking", "architecture", "security", "pipeline-infra", "performance")
CCN, NLOC = 10, 60


def relative(path: Column, root: str = "") -> Column:
    """A path under ``root`` with forward slashes; null if it is absolute, goes up or has a colon."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/")
    if base:
        inside = (F.lower(p) == base.lower()) | F.startswith(F.lower(p), F.lit(base.lower() + "/"))
        p = F.when(inside, F.substr(p, F.lit(len(base) + 2))).otherwise(p)
    p = F.regexp_replace(p, r"^(\./)+", "")
    return F.when((p != "") & ~p.rlike(r"^/|(^|/)\.\.(/|$)|:"), p)


def _map(pairs: dict, part: int | None = None) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v if part is None else v[part])])


def extra(**values: Column) -> Column:
    """A map of the values that are not null, as strings."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _signal(df: DataFrame, tool: str, family: Column, kind: Column, file: Column, lo: Column, hi: Column, message: Column, fact: bool, more: Column, need_file: bool = True) -> DataFrame:
    out = df.select(
        F.lit(tool).alias("tool"),
        family.alias("family"),
        kind.alias("kind"),
        file.alias("file"),
        lo.cast("int").alias("line_start"),
        hi.cast("int").alias("line_end"),
        message.alias("message"),
        F.lit(fact).alias("fact"),
        more.alias("extra"),
    )
    return out.where("file is not null") if need_file else out


def _records(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.explode(F.from_json("payload", f"array<struct<{schema}>>")).alias("r")).select("r.*")


def ruff(df: DataFrame, root: str = "") -> DataFrame:
    """NRM01: known codes only."""
    r = _records(df, "code string, filename string, message string, location struct<row int>, end_location struct<row int>")
    r = r.where(F.col("code").isin(*RUFF) & F.col("location.row").isNotNull())
    end = F.coalesce("end_location.row", "location.row")
    return _signal(r, "ruff", _map(RUFF, 0)[F.col("code")], _map(RUFF, 1)[F.col("code")], relative(F.col("filename"), root), F.col("location.row"), end, F.coalesce("message", F.lit("")), False, extra(code=F.col("code")))


def vulture(df: DataFrame, root: str = "") -> DataFrame:
    """NRM02: one line of text in each ``payload`` row; a symbol only where the message names one."""
    line = F.trim("payload")
    outer, inner = r"^(.+?):([0-9]+): (.+) \(([0-9]+)% confidence\)$", r"^unused (\w+) '([^']+)'$"
    r = df.where(line.rlike(outer)).select(*[F.regexp_extract(line, outer, i).alias(n) for i, n in enumerate(("file", "row", "msg", "conf"), 1)])
    named = lambda g: F.nullif(F.regexp_extract("msg", inner, g), F.lit(""))
    return _signal(r, "vulture", F.lit("dead-code"), F.lit("unused"), relative(F.col("file"), root), F.col("row"), F.col("row"), F.col("msg"), False, extra(confidence=F.col("conf"), symbol_kind=named(1), symbol=named(2)))


def lizard(df: DataFrame, root: str = "") -> DataFrame:
    """NRM03: headerless CSV rows of eleven columns in ``c0`` to ``c10``; hard or long units only."""
    n = {k: F.col(c).try_cast("int") for k, c in (("nloc", "c0"), ("ccn", "c1"), ("tokens", "c2"), ("parameters", "c3"), ("lo", "c9"), ("hi", "c10"))}
    r = df.where(F.forall(F.array(*n.values()), lambda x: x.isNotNull()) & ((n["ccn"] >= CCN) | (n["nloc"] >= NLOC)))
    message = F.format_string("%s has cyclomatic complexity %d over %d lines", F.col("c7"), n["ccn"], n["nloc"])
    return _signal(r, "lizard", F.lit("complex-units"), F.lit("complexity"), relative(F.col("c6"), root), n["lo"], n["hi"], message, False, extra(name=F.col("c7"), ccn=n["ccn"], nloc=n["nloc"], parameters=n["parameters"]))


def madge(df: DataFrame, root: str = "") -> DataFrame:
    """NRM04: one row per import cycle, unusable members left out."""
    r = df.select(F.explode(F.from_json("payload", "array<array<string>>")).alias("cycle"))
    r = r.select(F.filter(F.transform("cycle", lambda x: relative(x, root)), lambda x: x.isNotNull()).alias("kept")).where("size(kept) > 0")
    message = F.concat(F.lit("import cycle through "), F.size("kept").cast("string"), F.lit(" modules: "), F.array_join("kept", " -> "))
    return _signal(r, "madge", F.lit("architecture"), F.lit("cycle"), F.element_at("kept", 1), F.lit(None), F.lit(None), message, False, extra(cycle=F.to_json("kept")))


def jscpd(df: DataFrame, root: str = "") -> DataFrame:
    """NRM05: clone pairs without the duplicated text."""
    side = "struct<name string, start int, `end` int>"
    r = df.select(F.explode(F.from_json("payload", f"struct<duplicates array<struct<firstFile {side}, secondFile {side}, lines int, tokens int, format string>>>")["duplicates"]).alias("r")).select("r.*")
    r = r.withColumn("_other", relative(F.col("secondFile.name"), root)).where("_other is not null")
    message = F.concat(F.coalesce("lines", F.lit(0)).cast("string"), F.lit(" duplicated lines shared with "), "_other")
    more = extra(other_file=F.col("_other"), other_line_start=F.col("secondFile.start"), other_line_end=F.col("secondFile.end"), tokens=F.col("tokens"), format=F.col("format"))
    return _signal(r, "jscpd", F.lit("duplication"), F.lit("clone"), relative(F.col("firstFile.name"), root), F.col("firstFile.start"), F.col("firstFile.end"), message, False, more)


def knip(df: DataFrame, root: str = "") -> DataFrame:
    """NRM06: an array for each category becomes one row for each entry."""
    entry = "array<struct<name string, line int>>"
    kind = f"struct<issues array<struct<file string, {', '.join(f'{c} {entry}' for c in KNIP)}>>>"
    r = df.select(F.explode(F.from_json("payload", kind)["issues"]).alias("i")).select("i.*").withColumn("_file", relative(F.col("file"), root))

    def entries(category: str) -> Column:
        one = lambda e: F.struct(F.lit(category).alias("category"), F.coalesce(e["name"], F.lit("")).alias("name"), e["line"].alias("line"))
        return F.transform(F.coalesce(F.col(category), F.array().cast(entry)), one)

    every = F.flatten(F.array(*map(entries, KNIP)))
    r = r.select("_file", F.explode(every).alias("e")).select("_file", "e.*")
    whole = F.col("category") == "files"
    row = F.when(~whole, F.col("line"))
    message = F.when(whole, F.concat(F.lit("unused file "), "_file")).otherwise(F.concat(F.lit("unused "), _map(KNIP, 1)[F.col("category")], F.lit(" '"), "name", F.lit("'")))
    return _signal(r, "knip", _map(KNIP, 0)[F.col("category")], F.lit("unused"), F.col("_file"), row, row, message, False, extra(issue=F.col("category"), symbol=F.col("name")))


def _band(score: Column) -> Column:
    return F.when(score >= 9, 5).when(score >= 7, 4).when(score >= 4, 3).when(score > 0, 2).otherwise(1)


def osv_scanner(df: DataFrame, root: str = "", wanted: tuple[str, ...] | None = None) -> DataFrame:
    """NRM07: one row per advisory and package; severity by label, else best score, else its group's.

    A source's path is judged once, before its packages become rows. ``wanted`` names the values of ``extra`` to make, all where it is not
    given: a map is made whole even where one value of it is read.
    """
    vuln = "struct<id string, summary string, aliases array<string>, database_specific struct<severity string>, severity array<struct<score string>>>"
    package = f"struct<package struct<name string, version string, ecosystem string>, vulnerabilities array<{vuln}>, groups array<struct<ids array<string>, max_severity string>>>"
    r = df.select(F.explode(F.from_json("payload", f"struct<results array<struct<source struct<path string, type string>, packages array<{package}>>>>")["results"]).alias("r"))
    elsewhere = F.coalesce(F.col("r.source.type").isin("docker", "git"), F.lit(False))
    r = r.where(F.trim("r.source.path") != "").select("r", F.when(~elsewhere, relative(F.col("r.source.path"), root)).alias("_file"), elsewhere.alias("_elsewhere"))
    r = r.where(F.col("_elsewhere") | F.col("_file").isNotNull())
    bare = F.when(F.col("_elsewhere"), F.regexp_replace("r.source.path", r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1"))
    source = F.struct("_file", F.when(F.col("_elsewhere"), F.col("r.source.type")).alias("type"), bare.alias("path"))
    r = r.select(source.alias("source"), "r.packages").select("source", F.explode("packages").alias("p"))
    # each id's group is looked up once a package, before advisories become rows, so that none carries the groups
    none = F.array().cast("array<string>")
    groups = F.coalesce("p.groups", F.array().cast("array<struct<ids:array<string>,max_severity:string>>"))
    ids = F.flatten(F.transform(groups, lambda g: F.coalesce(g["ids"], none)))
    # scores become numbers once, before they are compared; what no number begins is not cast, as casts that fail are dear
    number = lambda c: F.when(c.rlike(r"^[\s\p{Cntrl}]*[+-]?[0-9.]"), c.try_cast("double"))
    within = lambda d: F.when(d.between(0, 10), d)
    levels = F.flatten(F.transform(groups, lambda g: F.array_repeat(number(g["max_severity"]), F.size(F.coalesce(g["ids"], none)))))
    r = r.select("source", "p.package", "p.vulnerabilities", ids.alias("_ids"), levels.alias("_levels"))
    best = lambda v: F.array_max(F.transform(F.transform(v["severity"], lambda s: number(s["score"])), within))
    own = F.transform("vulnerabilities", lambda v: F.struct(v.alias("v"), best(v).alias("best"), F.get("_levels", F.array_position("_ids", v["id"]).cast("int") - 1).alias("level")))
    r = r.select("source", "package", F.explode(own).alias("x")).select("source", "package", "x.v", "x.best", "x.level")
    label = _map(OSV_LABELS)[F.upper(F.trim("v.database_specific.severity"))]
    group = F.when(F.col("level").between(0, 10), _band(F.col("level")))
    severity = F.coalesce(label, F.when(F.col("best").isNotNull(), _band(F.col("best"))), group)
    field = lambda c: F.coalesce(c, F.lit(""))
    message = F.concat(field("package.name"), F.lit(" "), field("package.version"), F.lit(" ("), field("package.ecosystem"), F.lit(") is affected by "), field("v.id"), F.lit(": "), field("v.summary"))
    every = {
        "package": F.col("package.name"), "version": F.col("package.version"), "ecosystem": F.col("package.ecosystem"), "id": F.col("v.id"), "aliases": F.to_json(F.coalesce("v.aliases", F.array().cast("array<string>"))),
        "severity": severity, "source_type": F.col("source.type"), "source_path": F.col("source.path"),
    }
    more = extra(**{k: v for k, v in every.items() if wanted is None or k in wanted})
    return _signal(r, "osv-scanner", F.lit("dependency-debt"), F.lit("vuln"), F.col("source._file"), F.lit(None), F.lit(None), message, True, more, need_file=False)


def gitleaks(df: DataFrame, root: str = "") -> DataFrame:
    """NRM08: findings without the secret and its match; the column stays, for identity."""
    r = _records(df, "RuleID string, Description string, File string, StartLine int, EndLine int, StartColumn int, Entropy double").where("StartLine is not null")
    message = F.concat(F.coalesce("RuleID", F.lit("")), F.lit(": "), F.coalesce("Description", F.lit("possible committed secret")))
    more = extra(rule=F.col("RuleID"), entropy=F.col("Entropy"), column=F.col("StartColumn"))
    return _signal(r, "gitleaks", F.lit("security"), F.lit("secret"), relative(F.col("File"), root), F.col("StartLine"), F.coalesce("EndLine", "StartLine"), message, True, more)


def hadolint(df: DataFrame, root: str = "") -> DataFrame:
    """NRM09: levels as severities, unknown ones the lowest."""
    r = _records(df, "file string, line int, level string, code string, message string").where("line is not null")
    level = F.lower(F.coalesce("level", F.lit("")))
    message = F.concat(F.coalesce("code", F.lit("")), F.lit(": "), F.coalesce("message", F.lit("")))
    more = extra(code=F.col("code"), level=level, severity=F.coalesce(_map(HADOLINT_LEVELS)[level], F.lit(1)))
    return _signal(r, "hadolint", F.lit("pipeline-infra"), F.lit("dockerfile"), relative(F.col("file"), root), F.col("line"), F.col("line"), message, True, more)


def actionlint(df: DataFrame, root: str = "") -> DataFrame:
    """NRM10: diagnostics without the snippet."""
    r = _records(df, "message string, filepath string, line int, kind string").where("line is not null")
    return _signal(r, "actionlint", F.lit("pipeline-infra"), F.lit("workflow"), relative(F.col("filepath"), root), F.col("line"), F.col("line"), F.coalesce("message", F.lit("")), True, extra(check=F.col("kind")))


#: EXT02: normalisers by tool.
NORMALISERS = {"ruff": ruff, "vulture": vulture, "lizard": lizard, "madge": madge, "jscpd": jscpd, "knip": knip, "osv-scanner": osv_scanner, "gitleaks": gitleaks, "hadolint": hadolint, "actionlint": actionlint}


def checked(signals: DataFrame) -> DataFrame:
    """Signals with kind and family checked against their closed sets; a stranger is an error (NRM11)."""
    ok = F.col("kind").isin(*KINDS) & F.col("family").isin(*FAMILIES)
    return signals.withColumn("kind", F.when(ok, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind or family: "), "kind", F.lit("/"), "family"))))


def without_vendored(signals: DataFrame, pattern: str = r"(^|/)(vendor|node_modules|third_party|dist)/") -> DataFrame:
    """Signals outside vendored paths; those without a file stay (NRM12)."""
    return signals.where(F.col("file").isNull() | ~F.col("file").rlike(pattern))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Signals of several tools as one table (EXT02, JON38)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
