"""Folds over ordered rows, for groups of any size.

A fold carries a small state from row to row. :func:`fold` runs it with one task a key.
:func:`synchronised` also splits a key: its rows are cut anywhere along the order, each segment is
run from a guessed state (nothing yet), and then again from the state in which the segment before
it really ended, but only until both runs agree, for from there on they are the same. That is done
anew where the end of a segment changed by it, until nothing changes. Folds that restart at pauses
or full groups agree after a few rows.

A rule is a class with ``columns``, the row's values that it is called with. For
:func:`synchronised` it also has ``number``, the last group begun (-1 at first), ``state()``, a
tuple of all else that later answers depend on (None where they depend on nothing), and ``load``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import laid, same, written

#: A key of more rows is split over tasks.
WHOLE = 1_000_000


def stretches(batches, keys: list[str]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Stretches of equal keys of sorted batches, each with whether it begins its key. Null keys equal each other."""
    last = None
    for b in batches:
        if not len(b):
            continue
        own = b[keys]
        before = own.shift()
        new = (~((own == before) | (own.isna() & before.isna())).all(axis=1)).to_numpy()
        new[0] = True
        cuts = [*new.nonzero()[0].tolist(), len(b)]
        goes_on = last is not None and all((x is y) or x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(own.iloc[0], last))
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            yield i > 0 or not goes_on, b.iloc[lo:hi]
        last = tuple(own.iloc[-1])


def values(b: pd.DataFrame, columns) -> Iterator[tuple]:
    """Rows as tuples; a missing text is None."""
    return zip(*([x if isinstance(x, str) else None for x in b[c]] if isinstance(b[c].dtype, pd.StringDtype) and b[c].hasnans else b[c].tolist() for c in columns))


def fold(rows: DataFrame, keys: list[str], order: list[str], rule: type, name: str, **limits) -> DataFrame:
    """Adds ``name``: what a fresh ``rule`` answers for each row of a key, in order. Null keys form a key of their own. One task a key."""
    schema = T.StructType([*rows.schema.fields]).add(name, T.IntegerType())

    def run(batches):
        state = None
        for begins, b in stretches(batches, keys):
            state = rule(**limits) if begins else state
            out = [state(*row) for row in values(b, rule.columns)]
            yield b.assign(**{name: pd.Series(out, index=b.index, dtype="int32")})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _ends(rule: type, limits: dict):
    """(_first, state, begun) a segment: how it ends and how many groups begin in it, from the state that its first row carries.

    ``_known`` of that row holds the state to begin with, and how the segment ended from nothing.
    """

    def run(batches):
        now, done = None, False

        def close():
            return pd.DataFrame({"_first": [now[0]], "state": [end], "begun": [begun]})

        for begins, b in stretches(batches, ["_first"]):
            if begins:
                if now is not None:
                    yield close()
                now, done, guess, real = (int(b["_first"].iloc[0]),), False, None, rule(**limits)
                if b["_known"].iloc[0] is not None:
                    start, guessed_end, guessed_begun = pickle.loads(b["_known"].iloc[0])
                    guess = rule(**limits)
                    real.load(pickle.loads(start))
            if done:
                continue
            for row in values(b, rule.columns):
                real(*row)
                if guess is not None:
                    guess(*row)
                    if guess.state() == real.state():
                        done = True
                        break
            end, begun = (guessed_end, real.number - guess.number + guessed_begun) if done else (pickle.dumps(real.state()), real.number + 1)
        if now is not None:
            yield close()

    return run


def segments(table: DataFrame, keys: list[str], rule: type, limits: dict) -> DataFrame | None:
    """(_first, _known): for each segment but the first of a split key, the state and group number that it begins with. None if no key is split.

    A part of the sort order is at most the end of one key and the beginning of another, so there
    are no more than two segments a part: their states are few, whatever the keys and rows.
    """
    spark = table.sparkSession
    along = Window.partitionBy(*keys).orderBy("_part")
    spans = table.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"))
    split = spans.withColumn("before", F.lag("_first").over(along)).withColumn("after", F.lead("_first").over(along)).filter("before is not null or after is not null")
    split = written(split)
    before = {r["_first"]: r["before"] for r in split.select("_first", "before").collect()}
    if not before:
        return None
    own = split.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first")
    match = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        match = match & table[k].eqNullSafe(own[f"_k{i}"])
    body = written(table.join(F.broadcast(own), match).select("_first", "_row", *dict.fromkeys(rule.columns)))

    def run(known: dict[int, bytes | None]) -> dict[int, tuple]:
        blobs = F.broadcast(spark.createDataFrame(list(known.items()), "_at long, _known binary"))
        mine = body.join(blobs.select(F.col("_at").alias("_first")), "_first", "left_semi")
        rows = mine.join(blobs, F.col("_row") == F.col("_at"), "left").drop("_at").repartition("_first").sortWithinPartitions("_first", "_row")
        return {r["_first"]: (r["state"], r["begun"]) for r in rows.mapInPandas(_ends(rule, limits), "_first long, state binary, begun long").collect()}

    guessed = run(dict.fromkeys(before))
    ends, begins = dict(guessed), dict.fromkeys(before, pickle.dumps(None))
    while todo := {s: ends[p][0] for s, p in before.items() if p is not None and ends[p][0] != begins[s]}:
        ends |= run({s: pickle.dumps((start, *guessed[s])) for s, start in todo.items()})
        begins |= todo
    out, number = [], {}
    for s in sorted(before):
        p = before[s]
        number[s] = -1 if p is None else number[p] + ends[p][1]
        if p is not None:
            out.append((s, pickle.dumps((begins[s], number[s]))))
    return spark.createDataFrame(out, "_first long, _known binary")


def changes(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Which rows have other keys than the row before; null and NaN equal themselves. The first row has not."""
    out = np.zeros(len(b), bool)
    for k in keys:
        c = b.column(k)
        if pa.types.is_floating(c.type):
            c = pc.if_else(pc.is_nan(c), None, c)
        now, before = c.slice(1), c.slice(0, len(b) - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(pc.is_null(now), pc.is_null(before)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def listed(c: pa.Array) -> list:
    """``to_pylist``, for texts and numbers by way of numpy, which is several times as fast."""
    fast = pa.types.is_string(c.type) or not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type))
    return c.to_numpy(zero_copy_only=False).tolist() if fast else c.to_pylist()


def answered(batches, keys: list[str], rule: type, limits: dict) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray]]:
    """Sorted batches with the rule's answer for each row, and which rows have other keys than the row before in the batch.

    A key begins from nothing, or from the state in ``_known`` of its first row, if there is that column.
    """
    state, last = None, None
    for b in batches:
        if not len(b):
            continue
        new = changes(b, keys)
        first, last_before = b.slice(0, 1).select(keys), last
        last = b.slice(len(b) - 1).select(keys)
        if last_before is None or changes(pa.Table.from_batches([last_before, first]).combine_chunks().to_batches()[0], keys)[1]:
            state = None
        known = b.column("_known") if "_known" in b.schema.names else None
        columns = [listed(b.column(c)) for c in rule.columns]
        answers, cuts = [], [0, *np.flatnonzero(new).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo or state is None:
                state = rule(**limits)
                if known is not None and known[lo].is_valid:
                    start, number = pickle.loads(known[lo].as_py())
                    state.load(pickle.loads(start))
                    state.number = number
            answers += map(state, *[c[lo:hi] for c in columns])
        yield b, answers, new


def large_keys(rows: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame | None:
    """Keys of more than ``WHOLE`` rows, None if there are none. They number at most the rows over ``WHOLE``."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes.groupBy(*keys).agg(F.sum("_n").alias("_n"))
    many = written(counted.filter(F.col("_n") > WHOLE).select(*keys))
    return None if many.isEmpty() else many


def synchronised(rows: DataFrame, keys: list[str], order: list[str], rule: type, finish: Callable, schema: T.StructType, close: Callable | None = None, meet: Callable | None = None, sizes: DataFrame | None = None, **limits) -> DataFrame:
    """Runs a rule over each key in order, split keys included, and hands every row's answer to ``finish``.

    ``finish(batch, answers, new)`` makes the output of a batch of sorted rows; ``new`` marks rows of other keys
    than the row before. Most keys are small and run in one task behind one shuffle. Only keys of more than
    ``WHOLE`` rows are split: they are sorted over ranges and written first, so that segments stay what they are.
    Where an output row may go on in the next batch, ``close`` puts a task's batches together, and ``meet`` the
    rows of split keys, which also go on in other tasks. Rows of keys are counted, which makes ``rows`` once more;
    ``sizes`` (keys, _n), at least as many rows as each key has, spares that. A key said too large is only split in vain.
    """
    large = large_keys(rows, keys, sizes)

    def run(batches):
        made = (finish(*x) for x in answered(batches, keys, rule, limits))
        yield from close(made) if close else made

    few = rows if large is None else rows.join(F.broadcast(large), same(rows, large, keys), "left_anti")
    # sorts compare the first column fastest, and the last key tells most rows apart
    whole = few.repartition(*keys).sortWithinPartitions(*keys[::-1], *order).mapInArrow(run, schema)
    if large is None:
        return whole
    table = laid(rows.join(F.broadcast(large), same(rows, large, keys), "left_semi"), keys, order)
    known = segments(table, keys, rule, limits)
    if known is None:
        dealt = table.withColumn("_known", F.lit(None).cast("binary"))
    else:
        dealt = table.join(F.broadcast(known), F.col("_row") == F.col("_first"), "left").drop("_first")

    def pieces(batches):
        for x in answered(batches, [*keys, "_part"], rule, limits):
            yield finish(*x)

    split = dealt.repartition(*keys, "_part").sortWithinPartitions("_row").mapInArrow(pieces, schema)
    return whole.unionByName(meet(split) if meet else split)


def numbered(rows: DataFrame, keys: list[str], order: list[str], rule: type, name: str, sizes: DataFrame | None = None, **limits) -> DataFrame:
    """Adds ``name``: the rule's answer for each row of a key, in order, as :func:`fold` does, but a key may be spread over many tasks."""
    names = list(rows.columns)
    schema = T.StructType([*rows.schema.fields]).add(name, T.IntegerType())

    def finish(b: pa.RecordBatch, answers: list, new: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(answers, pa.int32())], names=[*names, name])

    return synchronised(rows, keys, order, rule, finish, schema, sizes=sizes, **limits)
