"""Event-history queries: sessions, runs, gaps, intervals, band and nearest joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import aggregates, joins, windows
from millrace.plans.registry import query
from millrace.sources.tables import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``t``, seconds since the epoch."""
    return table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query("""
WITH s AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, event_type, island, count(*) AS n FROM s GROUP BY 1, 2, 3)
SELECT user_id, CAST(max(n) AS BIGINT) AS longest FROM r GROUP BY 1""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of one event type for each user (WIN05)."""
    return windows.longest_run(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM m)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, CAST(count(*) AS BIGINT) AS n_events, min(ts) AS started, max(ts) AS ended, round(sum(value), 4) AS total FROM s GROUP BY 1, 2""")
def sessionise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with a gap of six hours (AGG09 with fixed primaries)."""
    s = windows.sessions(events(spark, sf_dir), "user_id", "t", F.lit(21600.0), "event_id")
    return s.groupBy("user_id", "session_no").agg(
        F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.round(F.sum("value"), 4).alias("total")
    )


@query("""
WITH m AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + 30 AS hi FROM orders),
w AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM m),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT o_custkey, min(lo) AS lo, max(hi) AS hi, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY o_custkey, island""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as 30-day intervals, united where they overlap or touch (WIN09)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("lo"), F.date_add(F.to_date("o_orderdate"), 30).alias("hi"))
    return windows.interval_union(o, ["o_custkey"], "lo", "hi", touch=1)


@query("""
SELECT a.event_id AS event_id, e.event_id AS error_id FROM events a JOIN events e ON a.user_id = e.user_id AND e.event_type = 'error' AND a.event_type <> 'error'
AND abs(epoch_us(a.ts) - epoch_us(e.ts)) <= 21600000000""")
def range_corroborate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within six hours of an error of the same user (JON07), keyed by user and time bucket."""
    e = events(spark, sf_dir)
    left = e.where("event_type <> 'error'").select("user_id", "event_id", "t")
    right = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("t").alias("rt"))
    return joins.bucketed_band_join(left, right, ["user_id"], "t", "rt", 21600.0).select("event_id", "error_id")


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS vid, user_id AS vu, ts AS vts FROM events WHERE event_type = 'view'),
j AS (SELECT event_id, vid, vts, row_number() OVER (PARTITION BY event_id ORDER BY vts DESC NULLS LAST, vid) AS rn FROM p LEFT JOIN v ON vu = user_id AND vts <= ts)
SELECT event_id, vid AS matched_id, vts AS matched_at FROM j WHERE rn = 1""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase's nearest earlier view by the same user (JON12): union and one window, no pairing."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("vts"), F.col("event_id").alias("vid"))
    return joins.latest_before(p, v, ["user_id"], "ts", "vts", "vid").select("event_id", "matched_id", "matched_at")


@query("""
WITH s AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 86400000000 AS lo, epoch_us(o_orderdate) // 86400000000 + 20 + o_orderkey % 50 AS hi FROM orders),
j AS (SELECT p.o_orderkey AS point_id, s.o_orderkey AS span_id, row_number() OVER (PARTITION BY p.o_orderkey ORDER BY s.hi - s.lo, s.lo DESC, s.o_orderkey DESC) AS rn FROM s p JOIN s ON p.o_custkey = s.o_custkey AND s.lo <= p.lo + 5 AND p.lo + 5 <= s.hi)
SELECT point_id, span_id FROM j WHERE rn = 1""")
def smallest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest of a customer's intervals around each point (JON20)."""
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000)
    o = table(spark, sf_dir, "orders")
    spans = o.select("o_custkey", day.alias("lo"), (day + 20 + F.col("o_orderkey") % 50).alias("hi"), F.col("o_orderkey").alias("span_id"))
    points = o.select("o_custkey", (day + 5).alias("at"), F.col("o_orderkey").alias("point_id"))
    return joins.smallest_enclosing(points, spans, ["o_custkey"], "at", "lo", "hi", "span_id").select("point_id", "span_id")


@query("""
WITH g AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS gap FROM orders)
SELECT o_custkey, CAST(median(gap) AS DOUBLE) AS usual, CAST(max(gap) AS BIGINT) AS longest, max(gap) > 4 * median(gap) AS irregular FROM g WHERE gap IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""")
def tag_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median against longest gap between a customer's orders, with five gaps at least (AGG08, WIN19)."""
    d = F.to_date("o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy(d, "o_orderkey")
    g = table(spark, sf_dir, "orders").select("o_custkey", F.datediff(d, F.lag(d).over(w)).alias("gap")).where("gap is not null")
    out = g.groupBy("o_custkey").agg(F.median("gap").alias("usual"), F.max("gap").cast("long").alias("longest"), F.count("*").alias("_n")).where("_n >= 5")
    return out.select("o_custkey", "usual", "longest", (F.col("longest") > 4 * F.col("usual")).alias("irregular"))


@query("""
WITH s AS (SELECT user_id, value > lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS up FROM events WHERE event_type = 'purchase')
SELECT user_id, bool_and(up) AS rising FROM s GROUP BY 1""")
def monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's purchases strictly rise; null with a single one (WIN12)."""
    return windows.monotonic(table(spark, sf_dir, "events").where("event_type = 'purchase'"), "user_id", "event_id", "value")


@query("""
SELECT conv_id, bool_and(turn = prev + 1) AS contiguous, CAST(count(*) AS BIGINT) AS turns FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1""")
def turn_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a conversation's turns follow one another without a gap (WIN12, PRD19)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("_p", F.lag("turn").over(w))
    return c.groupBy("conv_id").agg(F.bool_and(F.col("turn") == F.col("_p") + 1).alias("contiguous"), F.count("*").alias("turns"))


@query("""
WITH l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, count(*) = 3 AND count(DISTINCT event_type) = 1 AS stuck FROM l WHERE rn <= 3 GROUP BY 1""")
def repeat_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last three events are all of one type (WIN15)."""
    return windows.last_n_equal(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], "event_type", 3)


@query("""
WITH g AS (SELECT regexp_replace(props, '[0-9]+', 'N', 'g') AS signature, event_id, user_id, value FROM events WHERE event_type = 'error')
SELECT signature, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_pos, min_by(user_id, event_id) AS user_id, round(min_by(value, event_id), 6) AS value FROM g GROUP BY 1""")
def failure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors grouped by their properties with numbers masked, the first event's attributes kept (AGG12, FUN18)."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    g = aggregates.failure_groups(e, F.regexp_replace("props", "[0-9]+", "N"), "event_id", ["user_id", "value"])
    return g.withColumn("value", F.round("value", 6))


@query("SELECT user_id, event_type, max(event_id) AS event_id, round(max_by(value, event_id), 6) AS value FROM events GROUP BY 1, 2")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key (AGG18, JON10)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    return aggregates.keep_one(e, ["user_id", "event_type"], [-F.col("event_id")])


@query("SELECT user_id, event_type, min(event_id) AS event_id, round(min_by(value, event_id), 6) AS value FROM events GROUP BY 1, 2")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key (AGG18, SET01)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    return aggregates.keep_one(e, ["user_id", "event_type"], [F.col("event_id")])


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rn FROM events)
SELECT user_id, event_type, event_id, round(value, 6) AS value FROM r WHERE rn = 1""")
def dedupe_best_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with the best value of each key, ties by id (AGG18)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return aggregates.keep_one(e, ["user_id", "event_type"], [-F.col("value"), F.col("event_id")]).withColumn("value", F.round("value", 6))


@query("""
WITH b(band_no, band, lo, hi) AS (VALUES (0, 'day', 0, 1), (1, 'week', 1, 7), (2, 'month', 7, 31), (3, 'year', 31, 366), (4, 'older', 366, 100000), (5, 'future', -100000, 0)),
a AS (SELECT DATE '2001-08-01' - CAST(o_orderdate AS DATE) AS age FROM orders)
SELECT CAST(band_no AS INTEGER) AS band_no, band, CAST(count(age) AS BIGINT) AS n FROM b LEFT JOIN a ON age >= lo AND age < hi GROUP BY 1, 2""")
def histogram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by age band, empty bands kept (AGG06, FUN15)."""
    age = F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate"))
    band = F.when(age < 0, "future").when(age < 1, "day").when(age < 7, "week").when(age < 31, "month").when(age < 366, "year").otherwise("older")
    return aggregates.histogram(table(spark, sf_dir, "orders"), band, ["day", "week", "month", "year", "older", "future"])


@query("""
SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS done,
CAST(count(*) FILTER (WHERE event_type NOT IN ('error', 'purchase')) AS BIGINT) AS other FROM events GROUP BY 1""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts by status (AGG20, AGG26)."""
    t = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(t == "error").alias("failed"), F.count_if(t == "purchase").alias("done"), F.count_if(~t.isin("error", "purchase")).alias("other")
    )


@query("""
WITH f AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS since FROM events)
SELECT user_id, CAST(min(since) AS BIGINT) AS events_since FROM f JOIN (SELECT event_id FROM events WHERE event_type = 'error') USING (event_id) GROUP BY 1""")
def events_since_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each user had since the last error (WIN14): position in the newest-first list."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf_dir, "events").withColumn("_s", F.row_number().over(w) - 1).where("event_type = 'error'")
    return e.groupBy("user_id").agg(F.min("_s").cast("long").alias("events_since"))


@query("""
WITH s AS (SELECT event_id, user_id, ts, event_type, last_value(CASE WHEN event_type = 'login' OR event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events)
SELECT event_id, heading FROM s""")
def preceding_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest preceding row of a kind (WIN07)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    h = F.last(F.when(F.col("event_type").isin("login", "signup"), F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, sf_dir, "events").select("event_id", h.alias("heading"))


@query("""
WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS delta FROM events)
SELECT event_id, CAST(n + coalesce(sum(delta) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS moved_to FROM o""")
def moved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions mapped through the insertions before them (WIN17)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    delta = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(0)
    before = F.coalesce(F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) + before).cast("long").alias("moved_to"))
