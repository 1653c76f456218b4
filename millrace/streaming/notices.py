"""Notices on keys in three stages, as a batch fold and as keyed state of a stream with timers (STM02, STM07).

A key that is nominated gets a first notice, with what it says by then (``digest``). Seen again it is escalated, then removed. An anchor,
a changed digest or a mark to ignore it clears the notice, in this order; after a change a nomination starts anew. What is
older than the notice it meets is stale and changes nothing. A notice that is not seen for ``quiet`` days lapses.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import ship

DAY = 86_400_000

#: What is kept of a notice: stage, time in milliseconds, digest.
Notice = tuple[int, int, str | None]


def step(notice: Notice | None, at: int, digest: str | None, anchored: bool, ignored: bool, nominated: bool, quiet: int) -> tuple[Notice | None, list[tuple[int, str]]]:
    """The notice after a sighting and the actions it brings, ``(time, action)``."""
    said = []
    if notice and at > notice[1] + quiet * DAY:
        said.append((notice[1] + quiet * DAY, "lapse"))
        notice = None
    if notice and at < notice[1]:
        return notice, [*said, (at, "stale")]
    if notice and anchored:
        return None, [*said, (at, "clear-anchored")]
    if notice and digest != notice[2]:
        said.append((at, "clear-changed"))
        notice = None
    elif notice and ignored:
        return None, [*said, (at, "clear-ignore")]
    elif notice:
        return ((2, at, digest), [*said, (at, "escalate")]) if notice[0] == 1 else (None, [*said, (at, "remove")])
    if nominated and not anchored and not ignored:
        return (1, at, digest), [*said, (at, "notice")]
    return None, said


def noticed(sightings: DataFrame, quiet: int, upto: F.Column) -> DataFrame:
    """``key, ms, action`` of ``sightings(key, ms, id, digest, anchored, ignored, nominated)``, ``ms`` a time in milliseconds, told in order of time and id.

    A fold of each key over its sightings; a last notice lapses if its time is over by ``upto``.
    """
    ship(sightings.sparkSession)
    columns = ["ms", "id", "digest", "anchored", "ignored", "nominated"]
    rows = sightings.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("seen")).withColumn("upto", upto)
    key = dict(sightings.dtypes)["key"]

    def run(batches):
        import pandas as pd

        for p in batches:
            out = []
            for k, seen, end in p.itertuples(index=False):
                notice = None
                for s in seen:
                    notice, said = step(notice, s["ms"], s["digest"], s["anchored"], s["ignored"], s["nominated"], quiet)
                    out += [(k, *x) for x in said]
                if notice and notice[1] + quiet * DAY <= end:
                    out.append((k, notice[1] + quiet * DAY, "lapse"))
            if out:
                yield pd.DataFrame(out, columns=["key", "ms", "action"])

    return rows.mapInPandas(run, f"key {key}, ms long, action string")


def processor(quiet: int):
    """A stateful processor that keeps each key's notice, with a timer at the end of its quiet time."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Notices(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.kept = handle.getValueState("notice", "stage int, at long, digest string")

        def _keep(self, old: Notice | None, new: Notice | None) -> None:
            if old == new:
                return
            if old:
                self.handle.deleteTimer(old[1] + quiet * DAY)
            if new:
                self.kept.update(new)
                self.handle.registerTimer(new[1] + quiet * DAY)
            else:
                self.kept.clear()

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            seen = pd.concat(list(rows)).sort_values(["ms", "id"])
            held = tuple(self.kept.get()) if self.kept.exists() else None
            notice, out = held, []
            for s in seen.itertuples(index=False):
                notice, said = step(notice, int(s.ms), s.digest, bool(s.anchored), bool(s.ignored), bool(s.nominated), quiet)
                out += [(key[0], *x) for x in said]
            self._keep(held, notice)
            yield pd.DataFrame(out, columns=["key", "ms", "action"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.kept.clear()
            yield pd.DataFrame([(key[0], expiredTimerInfo.getExpiryTimeInMs(), "lapse")], columns=["key", "ms", "action"])

        def close(self) -> None:
            pass

    return Notices()


def noticed_stream(stream: DataFrame, quiet: int, late: str) -> DataFrame:
    """``noticed`` over a stream of sightings with their event time ``ts``: the same rows once all is read and nothing came later than ``late``.

    State is one small row a key in RocksDB, which a session must have as its state store; notices that lapse leave it by their timers.
    """
    ship(stream.sparkSession)
    key = dict(stream.dtypes)["key"]
    keyed = stream.withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(processor(quiet), f"key {key}, ms long, action string", "Append", "EventTime")
