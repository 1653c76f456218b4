from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from millrace.streaming import notices as N
from millrace.streaming import operators as S

D = N.DAY


def test_stages_and_what_clears_them():
    step = lambda notice, day, digest="a", anchored=False, ignored=False, nominated=True: N.step(notice, day * D, digest, anchored, ignored, nominated, 30)
    one, said = step(None, 1)
    assert one == (1, D, "a") and said == [(D, "notice")]
    two, said = step(one, 2)
    assert two == (2, 2 * D, "a") and said == [(2 * D, "escalate")]
    assert step(two, 3) == (None, [(3 * D, "remove")])
    assert step(two, 3, anchored=True, digest="b") == (None, [(3 * D, "clear-anchored")])
    assert step(two, 3, digest="b") == ((1, 3 * D, "b"), [(3 * D, "clear-changed"), (3 * D, "notice")])
    assert step(two, 3, digest="b", nominated=False) == (None, [(3 * D, "clear-changed")])
    assert step(two, 3, ignored=True) == (None, [(3 * D, "clear-ignore")])
    assert step(two, 1) == (two, [(D, "stale")]) and step(two, 2)[0] is None  # a notice of a later day is left alone, one of the same is not
    assert step(one, 31)[1] == [(31 * D, "escalate")]
    assert step(one, 32) == ((1, 32 * D, "a"), [(31 * D, "lapse"), (32 * D, "notice")])
    assert step(None, 1, anchored=True) == step(None, 1, ignored=True) == step(None, 1, nominated=False) == (None, [])


def test_a_stream_in_parts_says_what_the_batch_says(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(k % 7, start + timedelta(hours=5 * k + k % 3), k, f"d{k // 40 % 2}", k % 11 == 0, k % 13 == 0, k % 5 != 0) for k in range(240) if k % 7 != 3 or k < 90]
    rows = sorted(rows, key=lambda r: r[1])
    kind = "key long, ts timestamp, id long, digest string, anchored boolean, ignored boolean, nominated boolean"
    at = str(tmp_path / "in")
    for k in range(0, len(rows), 60):
        spark.createDataFrame(rows[k : k + 60], kind).coalesce(1).write.mode("append").parquet(at)
    ms = F.unix_millis("ts").alias("ms")
    seen = spark.read.parquet(at).select("*", ms)
    want = sorted(map(tuple, N.noticed(seen.drop("ts"), 2, F.lit(seen.agg(F.max("ms")).first()[0] - 3_600_000)).collect()))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", 1).parquet(at).select("*", ms)
        got = sorted(map(tuple, S.drained(N.noticed_stream(stream, 2, "1 hour"), "append").collect()))
    finally:
        spark.conf.set(store, before)
    assert got == want and {"notice", "escalate", "remove", "clear-anchored", "clear-changed", "clear-ignore", "lapse"} == {a for _, _, a in got}
