"""Streams: increments of words, change feeds, throttled progress, idempotent segments and job states.

No watermark is set where words are regrouped: words found late belong before earlier ones, and
dropping them would be wrong.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sequence import cues

FINAL = ("complete", "failed", "cancelled", "done")


def regroup(words: DataFrame, touched: DataFrame) -> DataFrame:
    """Cues of the tracks that new words touch, from all words of those tracks."""
    mine = words.join(touched.select("project", "track").distinct(), ["project", "track"], "left_semi")
    return cues(mine, deduplicate=True)


def follow_words(stream: DataFrame, append: Callable[[DataFrame, int], None], everything: Callable[[], DataFrame], replace: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is appended, and the tracks it touches are regrouped whole and replaced.

    ``append`` gets the batch number, so that a batch that is tried again is written once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        append(rows, number)
        replace(regroup(everything(), rows))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(log: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value isn't that of the row before; the first of a key always."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("before", F.lag(value).over(w)).withColumn("n", F.row_number().over(w)).filter((F.col("n") == 1) | ~F.col(value).eqNullSafe(F.col("before"))).drop("before", "n")


def until_final(log: DataFrame, keys: list[str], order: list[str], status: str = "status") -> DataFrame:
    """Rows up to and with the first final status of a key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col(status).isin(*FINAL).cast("int")).over(w), F.lit(0))
    return log.withColumn("ended", ended).filter("ended = 0").drop("ended")


def changes_stream(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """:func:`changes` of a stream of (key string, order long, value string), with the last row passed on as state.

    Rows of a micro-batch are put in order; a row that comes after a later one was passed on is old news and goes.
    """

    def step(k, batches, state):
        at, last = state.get if state.exists else (None, None)
        rows, out = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable"), []
        for n, v in zip(rows[order], rows[value]):
            if at is not None and n <= at:
                continue
            if at is None or v != last:
                out.append((k[0], n, v))
            at, last = int(n), v
        state.update((at, last))
        yield pd.DataFrame(out, columns=[key, order, value])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, {order} long, {value} string", "at long, last string", "append", "NoTimeout")


class Throttle:
    """1 for rows to pass on: the first, one ``least`` seconds after the last passed, or (with ``columns`` status) a new status."""

    columns = ("at", "status")

    def __init__(self, least: float = 0.5, on_change: bool = False):
        self.least, self.on_change, self.last, self.status = least, on_change, None, None

    def __call__(self, at: float, status) -> int:
        if self.last is None or at - self.last >= self.least or (self.on_change and status != self.status):
            self.last, self.status = at, status
            return 1
        return 0


def monotone(log: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Progress that never falls back."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn(value, F.max(value).over(w))


def staged(value: F.Column, stage: F.Column) -> F.Column:
    """Progress within a stage as progress of the whole job."""
    return F.when(stage == "prepare", value * 0.05).when(stage == "recognize", 0.05 + value * 0.85).when(stage == "recover", 0.9 + value * 0.08).otherwise(value * 0.98)


def new_segments(segments: DataFrame, done: DataFrame) -> DataFrame:
    """Segments (track, segment) that no checkpoint covers; a track marked complete has none left."""
    whole = done.filter("complete").select("track").distinct()
    return segments.join(whole, "track", "left_anti").join(done.select("track", "segment"), ["track", "segment"], "left_anti")


class Segments:
    """Segment checkpoints (track, segment, ..., complete) as a table that grows by streams, each segment once.

    A batch writes a folder of its own, named by its stream's checkpoint and its number, from what
    no other batch before it has: tried again, it writes the same. A row with ``complete`` marks
    its track as done; segments that come for it in later batches are not taken. One stream at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def table(self, run: str | None = None, before: int | None = None) -> DataFrame:
        """All segments; with ``run`` those that were there before one of its batches."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batches")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, run string, batch int").option("basePath", f"{self.root}/batches").parquet(f"{self.root}/batches")
        return (rows if run is None else rows.filter((F.col("run") != run) | (F.col("batch") < before))).drop("run", "batch")

    def take(self, rows: DataFrame, number: int, run: str = "r") -> None:
        new = new_segments(rows, self.table(run, number).select("track", "segment", F.coalesce("complete", F.lit(False)).alias("complete")))
        first = Window.partitionBy("track", "segment").orderBy(*[F.col(c) for c in rows.columns if c not in ("track", "segment") and not c.startswith("_")])
        once = new.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        once.write.mode("overwrite").parquet(f"{self.root}/batches/run={run}/batch={number}")

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        run = "r" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        return stream.writeStream.foreachBatch(lambda rows, number: self.take(rows, number, run)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_usage(log: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Roll-up of a log: entries, first time, seconds from the first entry to the last (times in seconds), highest value and their sum."""
    first, last = F.min(at), F.max(at)
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), first.alias("started"), (last - first).alias("elapsed"), F.max(value).alias("peak"), F.sum(value).alias("total"))


def job_states(log: DataFrame) -> DataFrame:
    """Job states by replay of a log (id, at, event): what was last asked or reported, unless it was already over."""
    state = {"create": "queued", "start": "running", "pause": "paused", "resume": "queued", "cancel": "cancelled", "finish": "done", "fail": "failed"}
    named = log.withColumn("status", F.element_at(F.create_map(*[F.lit(x) for p in state.items() for x in p]), F.col("event"))).filter("status is not null")
    return until_final(named, ["id"], ["at"]).groupBy("id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
