"""Sound: WAV files as a Spark data source, resampling by pieces, and recordings put end to end.

``spark.read.format("wav")`` after :func:`register` gives one row a piece of a recording. The
driver reads only headers and plans one partition for about ``partition`` seconds of a file, so a
film spreads over tasks; each task seeks to its own pieces.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.ranges import running

SCHEMA = "path string, rate int, channels int, piece long, samples array<float>"
#: Taps on either side of the middle, for each step of the coarser rate.
HALF = 10


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def listed(path: str) -> list[str]:
    """A file, or the .wav files of a folder in order of name."""
    from pyarrow import fs

    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        prefix = path.rstrip("/")
        return sorted(f"{prefix}/{i.base_name}" for i in system.get_file_info(fs.FileSelector(inner)) if i.base_name.lower().endswith(".wav"))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [path]


def header(path: str) -> dict:
    """Where the sound of a WAV file begins, and its kind: offset, frames, rate, channels, bits, floating."""
    system, inner = _opened(path)
    with system.open_input_file(inner) as f:
        riff = f.read(12)
        if len(riff) < 12 or riff[:4] not in (b"RIFF", b"RF64") or riff[8:] != b"WAVE":
            raise ValueError(f"no WAV file: {path}")
        at, size, kind = 12, f.size(), None
        while at + 8 <= size:
            f.seek(at)
            name, length = struct.unpack("<4sI", f.read(8))
            if name == b"fmt ":
                body = f.read(min(length, 40))
                code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
                code = struct.unpack("<H", body[24:26])[0] if code == 0xFFFE and len(body) >= 26 else code
                if code not in (1, 3) or (code, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
                    raise ValueError(f"unknown sample format {code} of {bits} bits: {path}")
                kind = {"rate": rate, "channels": channels, "bits": bits, "floating": code == 3}
            elif name == b"data" and kind:
                length = min(length, size - at - 8)  # streams write no length, or 2**32 - 1
                return kind | {"offset": at + 8, "frames": length // (kind["channels"] * kind["bits"] // 8)}
            at += 8 + length + length % 2
    raise ValueError(f"no sound in {path}")


def decoded(raw: bytes, bits: int, floating: bool, channels: int) -> np.ndarray:
    """Frames as the mean of their channels, -1 to 1."""
    if floating:
        x = np.frombuffer(raw, f"<f{bits // 8}").astype("float32")
    elif bits == 8:
        x = (np.frombuffer(raw, "u1").astype("float32") - 128) / 128
    elif bits == 24:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype("int32")
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x.astype("float32") / 2**23
    else:
        x = np.frombuffer(raw, f"<i{bits // 8}").astype("float32") / 2 ** (bits - 1)
    return x.reshape(-1, channels).mean(axis=1, dtype="float32")


class Stretch(InputPartition):
    """Pieces ``first`` to ``last`` (exclusive) of a file."""

    def __init__(self, path: str, first: int, last: int, kind: dict):
        self.path, self.first, self.last, self.kind = path, first, last, kind


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width, self.partition = options["path"], float(options.get("width", 30)), float(options.get("partition", 600))

    def partitions(self) -> list[Stretch]:
        out = []
        for path in listed(self.path):
            kind = header(path)
            size = round(self.width * kind["rate"])
            pieces, step = max(1, -(-kind["frames"] // size)), max(1, round(self.partition / self.width))
            out += [Stretch(path, first, min(pieces, first + step), kind) for first in range(0, pieces, step)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        kind, path = partition.kind, partition.path
        size, frame = round(self.width * kind["rate"]), kind["channels"] * kind["bits"] // 8
        system, inner = _opened(path)
        with system.open_input_file(inner) as f:
            for piece in range(partition.first, partition.last):
                f.seek(kind["offset"] + piece * size * frame)
                raw = f.read(min(size, kind["frames"] - piece * size) * frame)
                yield path, kind["rate"], kind["channels"], piece, decoded(raw, kind["bits"], kind["floating"], kind["channels"]).tolist()


class WavSource(DataSource):
    """Options: path (a file or a folder), width (seconds of a piece, 30), partition (seconds of a task, 600)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)


# ------------------------------------------------------------- resampling


def taps(up: int, down: int, half: int = HALF) -> np.ndarray:
    """A windowed sinc that passes what both rates can hold; ``up`` phases of the same filter."""
    most = max(up, down)
    n = np.arange(-half * most, half * most + 1)
    window = np.i0(5.0 * np.sqrt(np.maximum(0, 1 - (n / (half * most)) ** 2))) / np.i0(5.0)
    h = np.sinc(n / most) * window
    return h / h.sum() * up


def margin(up: int, down: int, half: int = HALF) -> int:
    """Samples before and after a piece that its output depends on."""
    return -(-half * max(up, down) // up) + 1


def converted(samples: np.ndarray, at: int, first: int, last: int, up: int, down: int, half: int = HALF) -> np.ndarray:
    """Output samples ``first`` to ``last`` (exclusive) of a signal of which ``samples`` begin at input sample ``at``; nothing lies outside.

    Output n is the sum over input k of samples[k] * taps[n * down - k * up]: every output stands
    alone, so pieces with their margins give what the whole signal gives.
    """
    if last - first > 8192:  # the table of inputs below stays small
        return np.concatenate([converted(samples, at, n, min(last, n + 8192), up, down, half) for n in range(first, last, 8192)])
    h, reach = taps(up, down, half), half * max(up, down)
    n = np.arange(first, last)
    # the inputs whose taps aren't 0, one row an output
    lowest = -((reach - n * down) // up)
    k = lowest[:, None] + np.arange(2 * reach // up + 1)
    tap = n[:, None] * down - k * up + reach
    good = (tap >= 0) & (tap < len(h)) & (k >= at) & (k < at + len(samples))
    x = np.where(good, samples[np.clip(k - at, 0, max(0, len(samples) - 1))] if len(samples) else 0.0, 0.0)
    return (x.astype("float64") * h[np.clip(tap, 0, len(h) - 1)]).sum(axis=1).astype("float32")


def resampled(pieces: DataFrame, keys: list[str], rate: int, to: int, width: float) -> DataFrame:
    """Pieces (keys, piece, samples) of ``width`` seconds at ``rate``, as pieces at the rate ``to``.

    Each piece gets the last samples of the one before and the first of the one behind by an
    equi-join, no more than the filter reaches; pieces of one recording need no order of tasks.
    """
    g = math.gcd(rate, to)
    up, down, size, new = to // g, rate // g, round(width * rate), round(width * to)
    if size * up != new * down or margin(up, down) > size:
        raise ValueError("a piece must hold a whole number of samples at both rates, and more than the filter reaches")
    reach = margin(up, down)
    own = pieces.select(*keys, F.col("piece").cast("long").alias("piece"), "samples")
    edge = lambda name, shift, cut: own.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], (F.col("piece") + shift).alias(f"_{name}_piece"), cut.alias(name))
    head = F.slice("samples", 1, reach)
    tail = F.slice("samples", F.greatest(F.lit(1), F.size("samples") - reach + 1), F.lit(reach))
    joined = own
    for name, other in (("before", edge("before", 1, tail)), ("after", edge("after", -1, head))):
        on = F.col("piece") == F.col(f"_{name}_piece")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{name}_{k}"))
        joined = joined.join(other, on, "left").drop(*[f"_{name}_{k}" for k in [*keys, "piece"]])

    @F.pandas_udf("array<float>")
    def turn(piece: pd.Series, samples: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for p, x, b, a in zip(piece.tolist(), samples, before, after):
            b = np.zeros(0, "float32") if b is None else np.asarray(b, "float32")
            a = np.zeros(0, "float32") if a is None else np.asarray(a, "float32")
            whole = np.concatenate([b, np.asarray(x, "float32"), a])
            last = min(p * new + new, -(-(p * size + len(x)) * up // down)) if len(x) < size else p * new + new
            out.append(converted(whole, p * size - len(b), p * new, last, up, down))
        return pd.Series(out, index=piece.index, dtype=object)

    return joined.select(*keys, "piece", turn("piece", "samples", "before", "after").alias("samples"))


# ------------------------------------------------------------- bundles


def placed_recordings(recordings: DataFrame, bundle: str, order: list[str], silence: float = 1.0) -> DataFrame:
    """Recordings with ``seconds`` one after the other in their bundle, each followed by silence: adds ``start`` and ``end``. A bundle of any size spreads over tasks."""
    ends = running(recordings, [bundle], order, {"_end": F.col("seconds") + silence})
    return ends.withColumn("start", F.col("_end") - silence - F.col("seconds")).withColumn("end", F.col("_end") - silence).drop("_end")


def bundled(pieces: DataFrame, placed: DataFrame, key: str, bundle: str, rate: int, width: float) -> DataFrame:
    """Pieces (bundle, piece, samples) of the bundles' sound: what ``placed`` says of where each recording starts, on the grid of samples.

    ``pieces`` are (key, piece, samples) of ``width`` seconds. A piece falls into at most two
    pieces of the bundle; silence is what no recording fills. A bundle that is louder than 1 is
    brought down to it.
    """
    size = round(width * rate)
    first = F.rint(F.col("start") * rate).cast("long") + F.col("piece") * size
    starts = placed.select(F.col(key).alias("_key"), bundle, "start")
    at = pieces.join(starts, F.col(key).eqNullSafe(F.col("_key"))).withColumn("at", first)
    to = F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.greatest(F.size("samples"), F.lit(1)) - 1) / size)))
    parts = at.withColumn("to", to).select(bundle, "to", (F.col("at") - F.col("to") * size).alias("shift"), "samples")
    lo, keep = F.greatest(F.lit(0), -F.col("shift")), F.least(F.col("shift") + F.size("samples"), F.lit(size)) - F.greatest("shift", F.lit(0))
    cut = parts.select(bundle, "to", F.greatest("shift", F.lit(0)).cast("int").alias("shift"), F.slice("samples", (lo + 1).cast("int"), keep.cast("int")).alias("samples"))
    ordered = cut.groupBy(bundle, "to").agg(F.array_sort(F.collect_list(F.struct("shift", "samples"))).alias("got"))
    silence = lambda n: F.when(n > 0, F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))).otherwise(F.array().cast("array<float>"))
    zero = F.array().cast("array<float>")
    laid = F.aggregate("got", zero, lambda out, g: F.concat(out, silence(g["shift"] - F.size(out)), g["samples"]))
    made = ordered.select(bundle, F.col("to").alias("piece"), laid.alias("samples"))
    # every piece between the first and the last of a bundle is whole
    last = made.groupBy(bundle).agg(F.max("piece").alias("last"), F.max(F.array_max(F.transform("samples", F.abs))).alias("peak"))
    grid = last.select(F.col(bundle).alias("_b"), "last", "peak", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("_p"))
    whole = grid.join(made, F.col("_b").eqNullSafe(F.col(bundle)) & (F.col("_p") == F.col("piece")), "left")
    got = F.coalesce("samples", zero)
    filled = F.when(F.col("_p") < F.col("last"), F.concat(got, silence(F.lit(size) - F.size(got)))).otherwise(got)
    scale = F.greatest(F.lit(1.0), F.coalesce("peak", F.lit(0.0)))
    return whole.select(F.col("_b").alias(bundle), F.col("_p").alias("piece"), F.transform(filled, lambda x: (x / scale).cast("float")).alias("samples"))



def seconds(pieces: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """Length of each recording."""
    return pieces.groupBy(*keys).agg((F.sum(F.size("samples")) / rate).alias("seconds"))
