"""Interval operators: range joins by bucket, and subtraction on a 20 ms grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP = 0.02


def between_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str = "at", width: float = 12.0) -> DataFrame:
    """Points with the ranges (start, end; both inclusive) that hold them.

    Ranges go to every bucket of ``width`` they touch and points to their own, so the join is an
    equi-join on keys and bucket with the exact test behind it; no nested loop over a track.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    spread = ranges.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    return points.withColumn("bucket", bucket(F.col(at))).join(spread, [*keys, "bucket"]).filter((F.col(at) >= F.col("start")) & (F.col(at) <= F.col("end"))).drop("bucket")


def words_in_gaps(words: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Words whose midpoint lies in a gap (gap_start, gap_end)."""
    middle = words.withColumn("at", (F.col("start") + F.col("end")) / 2).withColumnsRenamed({"start": "word_start", "end": "word_end"})
    return between_join(middle, gaps, keys).withColumnsRenamed({"start": "gap_start", "end": "gap_end"})


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint cell ranges (lo, hi; hi exclusive) that cover what the given ones cover."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, "lo", "hi", reach.alias("reach"), F.lead("lo").over(w).isNull().alias("last")).withColumn("new", F.coalesce(F.col("lo") > F.col("reach"), F.lit(True)))
    # a run ends at what the rows before the next run reach, the last one at what all rows reach
    most = F.greatest("reach", "hi")
    ends = F.lead(F.when(F.col("new"), F.col("reach")).otherwise(most)).over(Window.partitionBy(*keys).orderBy("lo", "hi", "last"))
    return marked.filter("new or last").select(*keys, "lo", F.coalesce(ends, most).alias("hi"), "new").filter("new").drop("new")


def _cells(rows: DataFrame, keys: list[str], start, end) -> DataFrame:
    """Grid cells touched by [start, end): whole cells from the one that holds the start to the one before the end."""
    return rows.select(*keys, F.floor(start / STEP).cast("long").alias("lo"), F.ceil(end / STEP).cast("long").alias("hi")).filter("hi > lo")


def uncovered(speech: DataFrame, words: DataFrame, durations: DataFrame, keys: list[str], least: float = 0.7, most: float = 12.0, margin: float = 0.15) -> DataFrame:
    """Stretches (start, end) of speech that no word covers, at least ``least`` long and cut at ``most``.

    Words are widened by ``margin``; one that is then over 2 s long covers only its first .8 s.
    Speech and words become sorted runs of grid cells and the difference is taken between runs:
    the grid itself is never expanded, so an hour of speech is a few rows.
    """
    start, end = F.greatest(F.col("start"), F.lit(0.0)), F.least(F.col("end"), F.col("duration"))
    spoken = _merged(_cells(speech.join(durations, keys), keys, start, end), keys)
    wide = words.join(durations, keys).select(*keys, F.greatest(F.col("start") - margin, F.lit(0.0)).alias("s"), F.least(F.col("end") + margin, F.col("duration")).alias("e"))
    short = F.when(F.col("e") - F.col("s") > 2, F.least(F.col("e"), F.col("s") + 0.8)).otherwise(F.col("e"))
    covered = _merged(_cells(wide, keys, F.col("s"), short), keys)
    # +1/-1 at the ends of runs: between two ends the state is constant
    marks = spoken.select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("cell"), F.lit(1).alias("s"), F.lit(0).alias("c")), F.struct(F.col("hi").alias("cell"), F.lit(-1).alias("s"), F.lit(0).alias("c")))).alias("m"))
    marks = marks.unionByName(covered.select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("cell"), F.lit(0).alias("s"), F.lit(1).alias("c")), F.struct(F.col("hi").alias("cell"), F.lit(0).alias("s"), F.lit(-1).alias("c")))).alias("m")))
    turns = marks.select(*keys, "m.*").groupBy(*keys, "cell").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    w = Window.partitionBy(*keys).orderBy("cell")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    state = turns.select(*keys, "cell", F.sum("s").over(so_far).alias("s"), F.sum("c").over(so_far).alias("c"), F.lead("cell").over(w).alias("next"))
    missing = _merged(state.filter("s > 0 and c = 0 and next is not null").select(*keys, F.col("cell").alias("lo"), F.col("next").alias("hi")), keys)
    length = (F.col("hi") - F.col("lo")) * STEP
    pieces = missing.filter(length >= least).withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(length / most).cast("int") - 1)))
    begin = F.col("lo") * STEP + F.col("piece") * most
    stop = F.least(F.col("hi") * STEP, begin + most)
    return pieces.filter(stop - begin >= least).select(*keys, begin.alias("start"), stop.alias("end"))


def gaps(rows: DataFrame, keys: list[str], order: list[str], over: float) -> DataFrame:
    """Islands of rows with no pause over ``over``: first start, last end, rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce(F.col("start") - F.lag("end").over(w) > over, F.lit(True)).cast("int")
    runs = rows.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("rows"))
