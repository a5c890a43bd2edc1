"""P06 as state: the newest version of each key wins, an answer that comes late is told as such, and keys that fall silent leave the state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_rocks(spark: SparkSession) -> None:
    """State of this kind is kept in RocksDB, on the executors' disks and in the checkpoint."""
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Newest(StatefulProcessor):
    """Keeps one version a key and the time of its last row; a timer forgets the key when the watermark is ``keep`` past that."""

    def __init__(self, key: str, order: str, time: str, others: list[str], schema: T.StructType, keep: int):
        self.key, self.order, self.time, self.others, self.kept, self.keep = key, order, time, others, schema, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", self.kept)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        there = self.state.get() if self.state.exists() else None
        best = None if there is None else Row(**{c: there[i] for i, c in enumerate([self.order, *self.others])})
        known, last, late = None if there is None else there[0], None if there is None else there[len(self.others) + 1], 0
        before = best
        for r in rows:
            last = max(x for x in (last, self.millis(r[self.time])) if x is not None)
            if known is not None and r[self.order] < known:
                late += 1  # a version that an earlier batch has overtaken
            elif best is None or r[self.order] > best[self.order]:
                best = Row(**{c: r[c] for c in [self.order, *self.others]})
        self.state.update((best[self.order], *(best[c] for c in self.others), last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.keep)
        if late or best is not before:
            yield Row(**{self.key: key[0], self.order: best[self.order], **{c: best[c] for c in self.others}, "late": late, "expired": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        there = self.state.get()
        self.state.clear()
        yield Row(**{self.key: key[0], **{c: there[i] for i, c in enumerate([self.order, *self.others])}, "late": 0, "expired": True})

    def close(self) -> None:
        pass

    @staticmethod
    def millis(at) -> int:
        return int(at.timestamp() * 1000)


def newest(events: DataFrame, key: str, order: str, time: str, keep: str = "1 day", late: str = "2 hours") -> DataFrame:
    """The newest version of each key (highest ``order``) whenever it changes: the key, ``order``, the other columns, ``late`` and ``expired``.

    ``late`` counts the rows of a batch that a version of an earlier batch has overtaken: answers to be ignored. A key without
    rows for ``keep`` of event time, as the watermark has it, is told once more (``expired``) and leaves the state, so
    the state holds the keys of that time and no others. Rows behind the watermark are dropped by Spark and
    counted in its progress. Equal versions: the one that came first stays. Rows without key, order or time are left out.
    """
    with_rocks(events.sparkSession)
    others = [c for c in events.columns if c not in (key, order, time)]
    field = {f.name: f for f in events.schema}
    part = lambda *names: [T.StructField(n, field[n].dataType) for n in names]
    state = T.StructType([*part(order, *others), T.StructField("_last", T.LongType())])
    out = T.StructType([*part(key, order, *others), T.StructField("late", T.LongType()), T.StructField("expired", T.BooleanType())])
    millis = int(events.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {keep}) AS x").first()["x"])
    whole = events.where(F.col(key).isNotNull() & F.col(order).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    return whole.groupBy(key).transformWithState(Newest(key, order, time, others, state, millis), out, "Update", "EventTime")


def settled(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The final version of each key, from all changes, and how many late rows it had."""
    others = [c for c in changes.columns if c not in (key, "late", "expired")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row"), F.sum("late").alias("late")).select(key, "_row.*", "late")
