"""Order-stateful folds: what no window can say, as each step depends on what was kept before.

Each runs over Arrow batches of keys in order with only the columns it needs. A fold over
one key is sequential by nature, so a key's rows meet in one task; the rows are a few
numbers each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from millrace.operators.windows import interval_union
from millrace.session import ship


def _folded(df: DataFrame, key: str, order: list[str], value: list[str], start: Callable[[], Callable], name: str, kind: str) -> DataFrame:
    """``df`` with a column ``name``: ``start()`` gives, for each key, a function of its rows' values that is called in order.

    Keys are dealt over the tasks and sorted there, so a task runs through all of its keys, and many small keys cost no more than a few
    large ones; a key's rows are never held together.
    """
    ship(df.sparkSession)
    columns = df.columns
    schema = StructType([*df.schema.fields, StructField(name, _parse_datatype_string(kind))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last, begun = None, None, False
        for batch in batches:
            out = []
            for k, *values in zip(batch.column(columns.index(key)).to_pylist(), *(batch.column(columns.index(v)).to_pylist() for v in value), strict=True):
                if not begun or not (k == last or (k != k and last != last)):
                    step, last, begun = start(), k, True
                out.append(step(*values))
            yield pa.RecordBatch.from_arrays([*(c.cast(t.type) for c, t in zip(batch.columns, arrow, strict=False)), pa.array(out, arrow[-1].type)], schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, *[F.asc_nulls_last(c) for c in order]).mapInArrow(run, schema)


def pack_in_order(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """``pack_no``: rows in order fill a pack until the next would exceed the budget; an oversize row is alone (WIN10)."""

    def start() -> Callable:
        no, used, some = 0, 0, False

        def step(n):
            nonlocal no, used, some
            n = math.nan if n is None else n
            if some and used + n > budget:
                no, used = no + 1, 0
            used, some = used + n, True
            return no

        return step

    return _folded(df, key, [order], [size], start, "pack_no", "long")


def keep_non_overlapping(df: DataFrame, key: str, lo: str, hi: str, tie: str) -> DataFrame:
    """``kept``: an interval is dropped if it overlaps one kept earlier; dropped ones block nothing (WIN13)."""

    def start() -> Callable:
        end, some = None, False

        def step(a, b):
            nonlocal end, some
            ok = not some or (a is not None and end is not None and a > end)
            end, some = b if ok else end, True
            return ok

        return step

    return _folded(df, key, [lo, tie], [lo, hi], start, "kept", "boolean")


def unique_names(df: DataFrame, key: str, order: str, base: str) -> DataFrame:
    """``name``: the base, or with -2, -3, ... the first that no earlier row has taken (WIN06)."""

    def start() -> Callable:
        taken, last = set(), {}

        def step(b):
            name, n = b, last.get(b, 1)
            while name in taken:
                n += 1
                name = f"{b}-{n}"
            last[b] = n
            taken.add(name)
            return name

        return step

    return _folded(df, key, [order], [base], start, "name", "string")


def merge_clusters(df: DataFrame, key: str, lo: str, hi: str, name: str, slack: int) -> DataFrame:
    """Clusters whose window grows as evidence joins: ``cluster`` is the smallest name, with the window and size (AGG09).

    A row joins if it starts at most ``slack`` after the largest end so far, which a running maximum says: no fold.
    """
    return interval_union(df, [key], lo, hi, slack, F.min(name).alias("cluster")).select(key, lo, hi, "cluster", "n")
