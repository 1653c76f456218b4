"""What several operators share: Arrow row mapping, hashing splits and graph components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from millrace.session import cut, ship

#: Rows that a worker turns into Python objects at a time, and about how many bytes of them.
SLICE, SLICE_BYTES = 256, 8 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``SLICE`` rows, fewer where rows are long."""
    step = max(1, min(SLICE, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """One output row per input row: ``make()`` gives, once per partition, a function of the row's values.

    Rows are handled in slices of ``SLICE``, fewer of them where they are long, so that a worker holds few texts at a time.
    """

    def rows(batch: pa.RecordBatch, f: Callable[..., tuple]) -> Iterable[tuple]:
        return [f(*values) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]

    return _mapped(df, make, rows, schema)


def flat_map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """As ``map_rows``, but each input row gives any number of output rows."""

    def rows(batch: pa.RecordBatch, f: Callable[..., Iterable[tuple]]) -> Iterable[tuple]:
        return [out for values in zip(*(c.to_pylist() for c in batch.columns), strict=True) for out in f(*values)]

    return _mapped(df, make, rows, schema)


def _mapped(df: DataFrame, make: Callable, rows: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                out = rows(part, f)
                if out:
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    # by place, as names may clash
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def fold(key: str, modulus: int) -> F.Column:
    """crc32 of the key as text, modulo; null keys give null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)


def row_hash(df: DataFrame) -> F.Column:
    """A hash of the whole row, columns that cannot be hashed as JSON."""
    kind = {f.name: f.dataType.typeName() for f in df.schema}
    plain = [F.col(f"`{c}`") for c in df.columns if kind[c] in ("string", "long", "integer", "double", "boolean")]
    others = [F.col(f"`{c}`") for c in df.columns if kind[c] not in ("string", "long", "integer", "double", "boolean")]
    return F.xxhash64(*plain, *([F.to_json(F.struct(*others))] if others else []))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs): ``(node, root)`` with root the smallest node reachable.

    Alternating large-star and small-star rounds on edge tables, each cut in the
    shared checkpoint folder; a round's minima are combined before the shuffle and
    the joins are plain equi-joins that adaptive execution may split, so no node's
    neighbours ever have to meet in one task. Only two counters reach the driver.
    """
    spark = edges.sparkSession
    e = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
        e = cut(small.select("p.u", "p.v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


#: SQL for DuckDB, which has no crc32: its table, bit by bit, as ``crc(t)``.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) AS c FROM range(256) r(i)))"


def sql_bytes(text: str) -> str:
    """SQL for the list of a text's UTF-8 bytes."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"


def sql_crc32(data: str) -> str:
    """SQL for the crc32 of a list of bytes, where ``crc`` is joined."""
    return f"xor(list_reduce({data}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"
