"""Reductions of audio windows held as arrays; samples become doubles before any rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def peaks(rows: DataFrame, key: str, samples: str = "samples", most: int = 160) -> DataFrame:
    """(key, block, peak): greatest absolute sample of each block of max(1, n div ``most``) samples, the first ``most`` blocks, four decimals."""
    n = F.size(samples)
    long = rows.select(key, F.greatest(F.lit(1), F.floor(n / most)).alias("width"), F.posexplode(samples).alias("i", "x"))
    blocks = long.select(key, F.floor(F.col("i") / F.col("width")).cast("int").alias("block"), F.abs(F.col("x").cast("double")).alias("x")).filter(F.col("block") < most)
    return blocks.groupBy(key, "block").agg(F.round(F.max("x"), 4).alias("peak"))


def rms(samples: Column) -> Column:
    """Root mean square of an array; 0 for an empty one."""
    squares = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.sqrt(squares / F.greatest(F.size(samples), F.lit(1)))


def normalized(samples: Column, level: float = 1.0) -> Column:
    """Scaled so that the greatest absolute sample is ``level``; silence stays."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    return F.transform(samples, lambda x: F.when(top > 0, x.cast("double") * level / top).otherwise(x.cast("double")))


def sampling_positions(duration: Column, window: float = 12.0) -> Column:
    """Distinct starting points of seven windows over a track, inside it."""
    shares = F.array(*[F.lit(x) for x in (0.02, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9)])
    return F.array_sort(F.array_distinct(F.transform(shares, lambda s: F.greatest(F.lit(0.0), F.least(s * duration, duration - window)))))


def mixed(speech: Column, noise: Column, decibels: Column) -> Column:
    """Speech with noise so many decibels below it, held to a peak of 1; the noise repeats to the speech's length."""
    level = rms(speech) / F.greatest(rms(noise) * F.pow(F.lit(10.0), decibels / 20), F.lit(1e-8))
    long = F.zip_with(speech, F.flatten(F.array_repeat(noise, F.ceil(F.size(speech) / F.greatest(F.size(noise), F.lit(1))).cast("int"))), lambda a, b: F.when(a.isNotNull(), a.cast("double") + F.coalesce(b, F.lit(0.0)).cast("double") * level))
    sums = F.slice(long, F.lit(1), F.size(speech))
    top = F.array_max(F.transform(sums, lambda x: F.abs(x)))
    return F.transform(sums, lambda x: F.when(top > 1, x / top).otherwise(x))
