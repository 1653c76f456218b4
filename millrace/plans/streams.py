"""Streaming queries over the event table as a file stream; each has its batch equivalent as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.sources.tables import table
from millrace.streaming import notices as N
from millrace.streaming import operators as S


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # a stream reads a folder; the glob names the table whether it is one file or many
    return S.read_events(spark, f"{sf_dir}/events.parquet*", schema)


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS started, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by type."""
    out = S.drained(S.tumbling(stream(spark, sf_dir), "event_type", "1 day", "1 hour"), "complete")
    return out.select(F.col("started").cast("timestamp_ntz").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM m)
SELECT min(ts) AS started, user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, no""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with a gap of six hours."""
    out = S.drained(S.session_counts(stream(spark, sf_dir), "user_id", "6 hours", "1 hour"), "complete")
    return out.select(F.col("started").cast("timestamp_ntz").alias("started"), "user_id", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user and type once, with a watermark longer than the history."""
    s = S.first_seen(stream(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "400 days")
    return S.drained(s.select("user_id", "event_type"), "append")


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last seen of each user (STM01)."""
    out = S.drained(S.latest_state(stream(spark, sf_dir), "user_id"), "complete")
    return out.select("user_id", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n")


#: Event types as what is seen of a user: an anchor, a mark to ignore, a nomination; the digest changes with every fifth event.
_SEEN = "SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id AS id, 'd' || (event_id // 5 % 2) AS digest, event_type = 'purchase' AS anchored, event_type = 'error' AS ignored, event_type <> 'signup' AS nominated FROM events"
_NOTICES = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, id) AS r FROM ({_SEEN})), q AS (SELECT 5 * 86400000 AS quiet, (SELECT max(ms) FROM e) - 3600000 AS upto),
s AS (SELECT DISTINCT key, 0::BIGINT AS r, 0 AS stage, 0::BIGINT AS since, NULL::VARCHAR AS kept, []::STRUCT(ms BIGINT, action VARCHAR)[] AS said FROM e
 UNION ALL SELECT key, r, CASE WHEN goes = 'escalate' THEN 2 WHEN fresh THEN 1 ELSE 0 END, CASE WHEN goes = 'escalate' OR fresh THEN ms ELSE 0 END, CASE WHEN goes = 'escalate' OR fresh THEN digest END,
  list_concat(CASE WHEN lapsed THEN [{{'ms': since + quiet, 'action': 'lapse'}}] ELSE [] END, CASE WHEN goes IS NOT NULL THEN [{{'ms': ms, 'action': goes}}] ELSE [] END, CASE WHEN fresh THEN [{{'ms': ms, 'action': 'notice'}}] ELSE [] END)
 FROM (SELECT *, nominated AND NOT anchored AND NOT ignored AND (NOT live OR goes = 'clear-changed') AS fresh
  FROM (SELECT *, CASE WHEN NOT live THEN NULL WHEN anchored THEN 'clear-anchored' WHEN digest <> kept THEN 'clear-changed' WHEN ignored THEN 'clear-ignore' WHEN stage = 1 THEN 'escalate' ELSE 'remove' END AS goes
   FROM (SELECT e.*, s.stage, s.since, s.kept, q.quiet, s.stage > 0 AND e.ms > s.since + q.quiet AS lapsed, s.stage > 0 AND e.ms <= s.since + q.quiet AS live FROM s JOIN e ON e.key = s.key AND e.r = s.r + 1, q)))),
z AS (SELECT key, unnest(said, recursive := true) FROM s UNION ALL SELECT key, since + quiet, 'lapse' FROM s, q WHERE stage > 0 AND since + quiet <= upto AND r = (SELECT max(r) FROM e WHERE e.key = s.key))
SELECT key, ms, action FROM z"""


def _sightings(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    ms = F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")
    digest = F.concat(F.lit("d"), F.expr("event_id div 5 % 2").cast("string")).alias("digest")
    return events.select(F.col("user_id").alias("key"), ms, F.col("event_id").alias("id"), digest, (kind == "purchase").alias("anchored"), (kind == "error").alias("ignored"), (kind != "signup").alias("nominated"), F.col("ts").cast("timestamp").alias("ts"))


@query(_NOTICES)
def notice_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of notices on users as their events come, in one batch (STM02, STM07)."""
    seen = _sightings(table(spark, sf_dir, "events")).drop("ts")
    last = seen.agg(F.max("ms")).first()[0] or 0
    return N.noticed(seen, 5, F.lit(last - 3_600_000))


@query(_NOTICES)
def stream_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from keyed state with timers over the stream of events (STM02, STM07)."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return S.drained(N.noticed_stream(_sightings(stream(spark, sf_dir)), 5, "1 hour"), "append")
    finally:
        spark.conf.set(store, before)
