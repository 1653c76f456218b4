"""Scalar text functions as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(c: Column) -> Column:
    """White space as single spaces, trimmed (FUN22)."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))


def fingerprint(*parts: Column) -> Column:
    """16 hex digits of a SHA-1 over the parts joined by bars; the last is collapsed first (FUN01)."""
    return F.substring(F.sha1(F.concat_ws("|", *parts[:-1], collapsed(parts[-1])).cast("binary")), 1, 16)


def span_suffix(start: Column, end: Column, column: Column) -> Column:
    """``:s-e@col``, shorter where end or column are null (FUN02)."""
    e = F.when(end.isNotNull() & (end != start), F.concat(F.lit("-"), end.cast("string"))).otherwise(F.lit(""))
    at = F.when(column.isNotNull(), F.concat(F.lit("@"), column.cast("string"))).otherwise(F.lit(""))
    return F.when(start.isNotNull(), F.concat(F.lit(":"), start.cast("string"), e, at)).otherwise(F.lit(""))


ASSIGNED = r"((?i:password|passwd|secret|token|api_?key)[\"']?[ ]*[:=][ ]*[\"']?[A-Za-z0-9+/_.=-]{4})[A-Za-z0-9+/_.=-]{8,}"
ISSUED = r"(AKIA|ghp_|xox[a-z]-|sk_live_)[A-Za-z0-9_-]{12,}"


def redacted(c: Column) -> Column:
    """Assigned secrets keep four characters, issued keys their prefix (FUN03)."""
    return F.regexp_replace(F.regexp_replace(c, ASSIGNED, "$1***"), ISSUED, "$1***")


def redacted_cut(c: Column, n: int) -> Column:
    """Redacted first, then cut: a cut first could leave half a secret unseen (FUN25)."""
    return F.left(redacted(c), F.lit(n))


def without_userinfo(url: Column) -> Column:
    """A URL without user and password (FUN04)."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")


def slug(c: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, trimmed, at most 64 (FUN10)."""
    return F.left(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(64))


def title_tokens(c: Column) -> Column:
    """Distinct words of a title (FUN09)."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != ""))


def error_class(c: Column) -> Column:
    """A message with URLs, quoted parts and numbers masked, at most 160 characters (FUN18)."""
    c = F.regexp_replace(c, r"https?://[^ \n\"']+", "URL")
    c = F.regexp_replace(c, r"\"[^\"]*\"|'[^']*'", "'?'")
    return F.left(F.regexp_replace(c, "[0-9]+", "N"), F.lit(160))


def indent_units(line: Column) -> Column:
    """(4 tabs + spaces) div 4 of the leading white space (FUN06)."""
    lead = F.regexp_extract(line, r"^([ \t]*)", 1)
    tabs = F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))
    return F.floor((4 * tabs + (F.length(lead) - tabs)) / 4)


def n_lines(c: Column) -> Column:
    """Lines, an unterminated last one included (SRC03)."""
    feeds = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return feeds + F.when((c != "") & ~F.endswith(c, F.lit("\n")), 1).otherwise(0)


def lines(c: Column) -> Column:
    """The lines without the empty one after a final line feed (SRC04)."""
    return F.split(F.regexp_replace(c, r"\n\z", ""), "\n")


def citation(c: Column) -> Column:
    """``struct(path, lo, hi)`` from ``path:N``, ``path:N-M``, ``path#LN`` or ``path#LN-LM`` (FUN17)."""
    part = lambda g: F.nullif(F.regexp_extract(c, r"^([^:#\s]+)(?::|#L)([0-9]+)(?:-L?([0-9]+))?$", g), F.lit(""))
    return F.struct(part(1).alias("path"), part(2).cast("int").alias("lo"), F.coalesce(part(3), part(2)).cast("int").alias("hi"))


def snake(c: Column) -> Column:
    """camelCase as snake_case, without lookaround (FUN08)."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def route_name(c: Column) -> Column:
    """A route or option name in one form: placeholders as {}, leading dashes off, - and . as _ (FUN16)."""
    c = F.regexp_replace(c, r"\{[^}]*\}|<[^>]*>|:[A-Za-z_]+", "{}")
    return F.regexp_replace(F.regexp_replace(F.lower(c), "^--?", ""), "[.-]", "_")


def joined_route(*parts: Column) -> Column:
    """Route parts with single slashes between and one at the start (FUN19)."""
    segments = F.filter(F.split(F.concat_ws("/", *parts), "/"), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def env_name(c: Column) -> Column:
    """A setting's environment name (FUN19)."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"))


def at_least(version: Column, floor: Column) -> Column:
    """Versions compared at the lower of the two precisions (FUN20)."""
    number = lambda v: F.transform(F.split(v, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    v, f = number(version), number(floor)
    n = F.least(F.size(v), F.size(f))
    return F.slice(v, F.lit(1), n) >= F.slice(f, F.lit(1), n)


def cell_value(c: Column) -> Column:
    """A table cell in one form: quotes and ticks off, yes and no words as booleans, words for none as null (FUN21)."""
    bare = F.lower(F.regexp_replace(F.trim(c), "^[`\"']+|[`\"']+$", ""))
    return F.when(bare.isin("yes", "true", "on", "y"), "true").when(bare.isin("no", "false", "off", "n"), "false").when(~bare.isin("", "-", "none", "n/a", "null"), bare)


def fence(c: Column) -> Column:
    """A code fence longer than any run of ticks in the text, three at least (FUN22)."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), lambda x: F.length(x))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def stem(path: Column) -> Column:
    """A file name up to its first dot, in lower case (FUN07)."""
    return F.lower(F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("."), F.lit(1)))


def identifiers(c: Column, least: int = 3) -> Column:
    """Distinct identifiers of a text (FUN07)."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), lambda x: F.length(x) >= least))


def comment(line: Column, marker: Column) -> Column:
    """What follows a comment marker; null without one (FUN11)."""
    at = F.instr(line, marker)
    return F.when(at > 0, F.trim(F.substr(line, at + F.length(marker))))


def severity(tool: Column, given: Column, trusted: tuple[str, ...], default: Column) -> Column:
    """A trusted tool's severity if it is 1 to 5, else the default (FUN23)."""
    n = given.try_cast("int")
    return F.when(tool.isin(*trusted) & n.between(1, 5), n).otherwise(default)


def lag_days(later: Column, earlier: Column) -> Column:
    """Whole days between two dates, 0 at least (FUN13)."""
    return F.greatest(F.lit(0), F.datediff(later, earlier))


def digest(c: Column, n: int) -> Column:
    """The first n hex digits of a SHA-256 (FUN14)."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, n)


def bounded_float(c: Column, lo: float = 0.0, hi: float = 10.0) -> Column:
    """A number in text within bounds, else null (FUN15)."""
    n = c.try_cast("double")
    return F.when(n.between(lo, hi), n)
