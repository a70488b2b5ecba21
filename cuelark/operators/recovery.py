"""Recovery of speech that recognition left out, in two passes.

Each gap between words is heard once with a narrow margin. A result that repeats itself is heard
again with a wide margin, and dropped if it still does. Only words whose middle lies in the gap
count. The recognizer is passed in. Audio is shuffled once, in blocks of pieces; what is cut for a
gap is wide enough for both passes, so that the second one needs no other look at the audio.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import repeats
from .folds import changes
from .ranges import placed, same, written
from .tracks import word_doubts

#: A recovered word as it comes back from Python.
FOUND = "struct<word:string,start:double,end:double,probability:double,flags:array<string>>"
#: Beyond this compression a text says the same again and again.
COMPRESSED = 2.4
#: Pieces and samples of a block of audio, unless a single request needs more; a task hands out about as many samples at a time.
PIECES, SAMPLES = 64, 1 << 20


def dealt(asked: DataFrame, audio: DataFrame, keys: list[str], rate: int, width: float) -> tuple[DataFrame, Callable]:
    """Requests (keys, gap, since, until in seconds) among the audio that they ask for, and a function that cuts it.

    The function takes the batches of a task and gives those of ``asked`` with ``samples`` beside them.
    ``audio`` holds pieces (keys, piece, samples) of ``width`` seconds, numbered from 0; only the
    last piece of a track may be shorter or be missing, another missing one fails the job. Pieces are
    shuffled once, never broadcast: what Spark knows of their size may be that of rows not yet exploded.
    A block of a track gets its pieces and as many of the next one as the longest request needs, so
    that each request lies whole in the block in which it begins. ``asked`` is run twice, first for that.
    """
    size = round(width * rate)
    lo, hi = F.rint(F.col("since") * rate).cast("long"), F.rint(F.col("until") * rate).cast("long")
    ends = asked.select(*keys, F.struct(*asked.columns).alias("_asked"), F.floor(lo / size).alias("_first"))
    reach = asked.agg(F.max(F.floor(F.greatest(lo, hi - 1) / size) - F.floor(lo / size))).first()[0] or 0
    block = max(1, reach, min(PIECES, SAMPLES // size))
    piece = F.col("piece").cast("long")
    held = audio.filter("piece is not null").select(*keys, F.explode(F.sequence(F.floor(F.greatest(piece - reach, F.lit(0)) / block), F.floor(piece / block))).alias("_block"), piece.alias("_piece"), "samples")
    both = held.unionByName(ends.select(*keys, F.floor(F.col("_first") / block).alias("_block"), "_asked"), allowMissingColumns=True)
    # null as the number of a piece marks a request: those of a block follow its audio
    rows = both.repartition(*keys, "_block").sortWithinPartitions(*keys[::-1], "_block", F.col("_piece").asc_nulls_last())
    return rows, _cutter([*keys, "_block"], asked.columns, rate, size)


def slices(asked: DataFrame, audio: DataFrame, keys: list[str], rate: int, width: float) -> DataFrame:
    """``asked`` with its ``samples``; see :func:`dealt`."""
    rows, cut = dealt(asked, audio, keys, rate, width)
    return rows.mapInArrow(cut, T.StructType([*asked.schema.fields, audio.schema["samples"]]))


def _cutter(keys: list[str], names: list[str], rate: int, size: int) -> Callable:
    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        group, wanted = np.cumsum(changes(b, keys)), pc.is_null(b.column("_piece")).to_numpy(zero_copy_only=False)
        there, at = np.flatnonzero(~wanted), np.flatnonzero(wanted)
        if not len(at):
            return
        asked = b.column("_asked").take(pa.array(at))
        lo, hi = (np.rint(asked.field(x).to_numpy() * rate).astype("int64") for x in ("since", "until"))
        first, last = lo // size, np.maximum(lo, hi - 1) // size
        pieces, bounds, values = b.column("_piece").take(pa.array(there)).to_numpy(), b.column("samples").offsets.to_numpy().astype("int64"), b.column("samples").values
        begin, end = bounds[:-1][there], bounds[1:][there]
        # pieces of all blocks as one rising row of numbers, with a step of more than one where one is missing
        span = max(pieces.max(initial=0), last.max()) + 2
        row = group[there] * span + pieces
        a, z = np.searchsorted(row, group[at] * span + first), np.searchsorted(row, group[at] * span + last, "right")
        some = np.flatnonzero(z > a)
        a_, z_ = a[some], z[some] - 1
        torn, short = np.cumsum(np.diff(row, prepend=row[:1] - 1) != 1), np.cumsum(end - begin != size)
        if (row[a_] != (group[at] * span + first)[some]).any() or (torn[z_] != torn[a_]).any() or (np.where(z_ > a_, short[z_ - 1] - short[a_] + (end - begin != size)[a_], 0) > 0).any():
            raise ValueError("a piece of audio is missing")
        start, stop = np.zeros(len(at), "int64"), np.zeros(len(at), "int64")
        start[some] = begin[a_] + (lo - first * size)[some]
        stop[some] = np.minimum(start[some] + (hi - lo)[some], end[z_])
        stop = np.maximum(start, stop)
        shares = np.flatnonzero(np.diff(np.cumsum(stop - start) // SAMPLES)) + 1
        for mine in np.split(np.arange(len(at)), shares):
            samples = _lists(np.cumsum((stop - start)[mine]), pa.concat_arrays([values.slice(x, y - x) for x, y in zip(start[mine].tolist(), stop[mine].tolist())]))
            rows = asked.slice(mine[0], len(mine)).flatten()
            yield pa.RecordBatch.from_arrays([*rows, samples], [*names, "samples"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            b = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
            # the last block may go on in the next batch
            known = max(np.flatnonzero(changes(b, keys)), default=0)
            if known:
                yield from cut(b.slice(0, known))
            held = [b.slice(known)]
        for b in held:
            yield from cut(b)

    return run


def _heard(cut: Callable, make: Callable[[], Callable], names: list[str], rate: int, margins: tuple[float, float], language: str | None) -> Callable:
    """What :func:`recover` does in a task, behind ``cut``: rows of ``names`` with retried, language, text and words."""

    def doubtful(segment: tuple) -> bool:
        return segment[1] is not None and not segment[1] <= COMPRESSED or repeats(segment[0])

    def hear(b: pa.RecordBatch, model: Callable) -> pa.RecordBatch:
        first, last, duration, begun = (b.column(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "duration", "since"))
        begun = np.rint(begun * rate)
        near, far = ((np.maximum(0.0, first - m), np.fmin(duration, last + m)) for m in margins)
        cuts = [(np.rint(x * rate) - begun).astype("int64").tolist() for x in (*near, *far)]
        bounds, samples = b.column("samples").offsets.to_numpy().tolist(), b.column("samples").values.to_numpy(zero_copy_only=False)
        retried, languages, words, traits, sizes, ends = [], [], [], [], [], [0]
        for at, to, a, z, far_a, far_z in zip(bounds, bounds[1:], *cuts):
            mine = samples[at:to]
            found, tongue = model(mine[a:z].astype("float32"), language)
            retried.append(any(map(doubtful, found)))
            if retried[-1]:
                found, tongue = model(mine[far_a:far_z].astype("float32"), language)
            for _, compression, quiet, logprob, said in found:
                traits.append((logprob, quiet, compression))
                sizes.append(len(said))
                words += said
            ends.append(len(words))
            languages.append(language or tongue)
        # words in track time, clipped to what was heard, whose middle lies in the gap
        row, again = np.repeat(np.arange(len(b)), np.diff(ends)), np.array(retried, bool)
        said, *rest = zip(*words) if words else [()] * 4
        start, end, probability = (np.array(x, "float64") for x in rest)
        since, until = (np.where(again, f, n)[row] for f, n in zip(far, near))
        begin = np.maximum(0.0, np.minimum(until - since, start))
        stop = np.maximum(begin, np.minimum(until - since, end))
        middle = (since + begin + (since + stop)) / 2
        keep = (middle >= first[row]) & (middle <= last[row])
        texts, kept, spoken = [], keep.tolist(), [w or "" for w in said]
        for a, z, twice in zip(ends, ends[1:], retried):
            text = "".join(compress(spoken[a:z], kept[a:z]))
            if twice and repeats(text):
                text, keep[a:z] = "", False
            texts.append(text)
        logprob, quiet, compression = np.repeat(np.array(traits, "float64").reshape(-1, 3), sizes, axis=0)[keep].T
        rules = word_doubts(probability[keep], logprob, quiet, compression, begin[keep], stop[keep], np.ones(keep.sum(), bool))
        doubts = np.array([test for _, test in rules]).T
        flags = _lists(np.cumsum(doubts.sum(axis=1)), pa.array([name for name, _ in rules]).take(pa.array(np.nonzero(doubts)[1])))
        columns = [pa.array(list(compress(said, keep.tolist())), pa.string()), (since + begin)[keep], (since + stop)[keep], pa.array(probability[keep], from_pandas=True), flags]
        found = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["word", "start", "end", "probability", "flags"])
        made = [pa.array(retried, pa.bool_()), pa.array(languages, pa.string()), pa.array(texts, pa.string()), _lists(np.append(0, np.cumsum(keep))[ends[1:]], found)]
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *made], [*names, "retried", "language", "text", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in cut(batches):
            yield hear(b, model)

    return run


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values)


def recover(
    gaps: DataFrame, audio: DataFrame, durations: DataFrame, keys: list[str], make: Callable[[], Callable], rate: int = 16_000, width: float = 30.0, narrow: float = 0.4, wide: float = 2.0, language: str | None = None
) -> DataFrame:
    """A row a gap: keys, gap (its number in the track, from 0), start, end, retried, language, text, words.

    ``gaps`` (keys, start, end) come from :func:`intervals.uncovered`, ``durations`` (keys,
    duration) clip the margins. Only the gaps that the first pass failed on are heard again, by the
    task that has their audio. Gaps of a track without audio are silent. ``make`` runs once a task and
    gives a function of samples and language that returns segments (text, compression, no_speech,
    logprob, words) and a language; times are within the samples.
    """

    # written, as a sort over ranges runs its rows twice
    numbered = placed(written(gaps), keys, ["start"], "gap")
    lengths = durations.select(*keys, "duration")
    known = numbered.join(lengths, same(numbered, lengths, keys)).select(*[numbered[c] for c in numbered.columns], lengths["duration"])
    names = [*keys, "gap", "start", "end"]
    margin = max(narrow, wide)
    asked = written(known.select(*names, "duration", F.greatest(F.lit(0.0), F.col("start") - margin).alias("since"), F.least(F.col("duration"), F.col("end") + margin).alias("until")))
    rows, cut = dealt(asked, audio, keys, rate, width)
    kinds = dict(asked.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "retried boolean", "language string", "text string", f"words array<{FOUND}>"])
    return written(rows.mapInArrow(_heard(cut, make, names, rate, (narrow, wide), language), schema))


def recovered_words(found: DataFrame, keys: list[str]) -> DataFrame:
    """Words to add to the track; their chunk counts down from -1, so that no recognized chunk has it."""
    return found.select(*keys, (-F.col("gap") - 1).cast("int").alias("chunk"), "language", F.explode("words").alias("w")).select(*keys, "chunk", "w.word", "w.start", "w.end", "w.probability", "language", "w.flags")


def evidence(found: DataFrame, keys: list[str]) -> DataFrame:
    """What was looked at: a row a gap, with whether it took two passes and what was heard."""
    return found.select(*keys, "gap", "start", "end", "retried", "text")
