"""Alerts about sources, told while their runs arrive: state per source in the state store, timers for overdue ones."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.audit import DROP, LOOK_BACK, STREAK

ALERTS = "source_id long, id long, alert string, found long, before long, streak int"
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watch(StatefulProcessor):
    """Of each source the last LOOK_BACK completed runs (id, found), and, if runs are due, a timer after the last.

    A run is told to have dropped if it found less than a share of the run before it, and its streak of runs that found
    nothing if that is long enough. A run that comes after later ones of its source takes its place among those kept; one
    that was seen already, or is older than all of a full memory, changes nothing."""

    def __init__(self, share: float = DROP, streak: int = STREAK, look_back: int = LOOK_BACK, due_ms: int | None = None):
        self.share, self.streak, self.look_back, self.due_ms = share, streak, look_back, due_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "id long, found long")
        self.timer = handle.getValueState("timer", "at long") if self.due_ms else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = {r[0]: r[1] for r in self.runs.get()}
        latest, told = max(kept, default=None), []
        full, oldest = len(kept) >= self.look_back, min(kept, default=None)
        new = {}
        for r in rows:
            if r.id not in kept and not (full and r.id < oldest):
                new[r.id] = r.found
                told.append((r.id, r.finished_ms))
        every = sorted({**kept, **new}.items())
        for k, (run, found) in enumerate(every):
            if run not in new:
                continue
            before = every[k - 1][1] if k else None
            zeros = 0
            while zeros < min(self.look_back, k + 1) and every[k - zeros][1] == 0:
                zeros += 1
            if before is not None and found < before * self.share:
                yield Row(source_id=key[0], id=run, alert="drop", found=found, before=before, streak=zeros)
            if zeros >= self.streak:
                yield Row(source_id=key[0], id=run, alert="zeros", found=found, before=before, streak=zeros)
        if new:
            self.runs.put([Row(id=i, found=n) for i, n in every[-self.look_back :]])
            last = max(told)
            if self.due_ms and (latest is None or last[0] > latest):
                if self.timer.exists():
                    self.handle.deleteTimer(self.timer.get()[0])
                self.timer.update((last[1] + self.due_ms,))
                self.handle.registerTimer(last[1] + self.due_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        run, found = max((r[0], r[1]) for r in self.runs.get())
        self.timer.clear()
        yield Row(source_id=key[0], id=run, alert="overdue", found=found, before=None, streak=None)

    def close(self) -> None:
        pass


def watch(runs: DataFrame, due_hours: float | None = None, late: str = "1 day") -> DataFrame:
    """ALERTS of a stream of runs (id, source_id, status, competitions_found_comp, competitions_found_training, and
    finished_at if runs are due): only completed ones count, a null number of events is 0. With due_hours a source is
    told to be overdue once the watermark (the latest finished_at less `late`) has passed that long after its last run."""
    found = F.coalesce("competitions_found_comp", F.lit(0)) + F.coalesce("competitions_found_training", F.lit(0))
    done = runs.where("status = 'completed' AND source_id IS NOT NULL AND id IS NOT NULL")
    at = F.unix_millis("finished_at") if due_hours else F.lit(0).cast("long")
    kept = ["finished_at"] if due_hours else []
    rows = done.select(F.col("source_id").cast("long").alias("source_id"), F.col("id").cast("long").alias("id"), found.cast("long").alias("found"), at.alias("finished_ms"), *kept)
    if due_hours:
        rows = rows.withWatermark("finished_at", late)
    processor = Watch(due_ms=int(due_hours * 3_600_000) if due_hours else None)
    return rows.groupBy("source_id").transformWithState(processor, ALERTS, "Append", "EventTime" if due_hours else "None")


def start(spark: SparkSession, alerts: DataFrame, path: str, offsets: str) -> StreamingQuery:
    """Starts the stream of alerts into Parquet files; started again with the same folders it goes on where it was.
    Keyed state needs the store that writes changes only; the session's own setting stays as it is."""
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        return alerts.writeStream.format("parquet").option("path", path).option("checkpointLocation", offsets).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE[0], before)
