"""Windows: runs, islands, interval union, batching, gaps, greedy selection and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut


def longest_run(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The longest run of equal consecutive values of each key; null values are transparent (WIN05)."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = df.where(F.col(value).isNotNull())
    seen = seen.withColumn("_island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, value).orderBy(*order)))
    runs = seen.groupBy(key, value, "_island").agg(F.count("*").alias("_n"))
    return runs.groupBy(key).agg(F.max("_n").alias("longest"))


def interval_union(df: DataFrame, keys: list[str], lo: str, hi: str, touch: int = 0, *more: Column) -> DataFrame:
    """Union of overlapping intervals, or of those at most ``touch`` apart (WIN09), with their number and ``more`` aggregates."""
    before = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_top", F.max(hi).over(before))
    marked = marked.withColumn("_new", F.when(F.col("_top").isNull() | (F.col(lo) > F.col("_top") + touch), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(upto))
    return islands.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n"), *more).drop("_island")


def sessions(df: DataFrame, key: str, at: str, gap: Column | float, tie: str) -> DataFrame:
    """Rows with ``session_no`` within the key: a gap above ``gap`` starts a new one (AGG09, fixed primaries)."""
    w = Window.partitionBy(key).orderBy(at, tie)
    new = F.when(F.lag(at).over(w).isNull() | (F.col(at) - F.lag(at).over(w) > gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Global 1-based positions in a total order (WIN01), without a single-task window.

    Rows are range-partitioned and sorted; each partition's rows are numbered by themselves
    and shifted by the sizes of the partitions before it, of which the driver holds a list.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    laid = laid.withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["_part"]: r["count"] for r in laid.groupBy("_part").count().collect()}
    start, at = 0, []
    for k in sorted(sizes):
        at.append((k, start))
        start += sizes[k]
    shift = spark.createDataFrame(at, "_part int, _start long")
    return laid.join(F.broadcast(shift), "_part").withColumn(name, F.col("_n") + F.col("_start") + 1).drop("_part", "_n", "_start")


def greedy_top(df: DataFrame, priority: str, key: str, group: str, n: int, spread: float) -> DataFrame:
    """Top n by priority with at most ceil(spread n) of a group: position, in_top, spread_capped (WIN01, WIN02).

    The greedy walk takes exactly the first n rows whose ordinal in their group is within
    the cap. So only the first ``cap`` rows of each group compete (a window group limit
    drops the others before the shuffle), the n-th of them in order is the last chosen, and
    each row's flags follow from its place before or after that one.
    """
    cap = -(-n * spread // 1)
    order = [F.desc(priority), F.asc(key)]
    best = df.select(key, priority, group).withColumn("_g", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_g") <= cap)
    chosen = best.orderBy(*order).limit(int(n))
    last = chosen.agg(F.count("*").alias("_chosen"), F.min(F.struct(F.col(priority).alias("p"), (-F.col(key)).alias("k"))).alias("_last"))
    ok = best.select(F.col(key).alias("_key"), F.lit(True).alias("_ok"))
    place = F.struct(F.col(priority).alias("p"), (-F.col(key)).alias("k"))
    out = numbered(df, order).join(ok, F.col(key) == F.col("_key"), "left").join(F.broadcast(last))  # one row
    within = (F.col("_chosen") < n) | (place >= F.col("_last"))
    eligible = F.coalesce("_ok", F.lit(False))
    return out.select(*df.columns, "position", (eligible & within).alias("in_top"), (~eligible & within).alias("spread_capped"))


def cap_per_group(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group (WIN03); plans as a window group limit."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def batches(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """``batch_no`` of fixed-size batches within each group (WIN08)."""
    return df.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size))


def last_n_equal(df: DataFrame, key: str, order: list[Column], value: str, n: int) -> DataFrame:
    """Whether the last n values of each key exist and are all the same (WIN15)."""
    last = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n)
    return last.groupBy(key).agg(((F.count("*") == n) & (F.count_distinct(value) == 1)).alias("stuck"))


def monotonic(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Whether values strictly rise in order; null for a single row (WIN12)."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_up", F.col(value) > F.lag(value).over(w)).groupBy(key).agg(F.bool_and("_up").alias("rising"))
