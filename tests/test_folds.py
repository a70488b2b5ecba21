"""Folds over one hot track against the sequential fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelark.operators import folds, ranges, sequence

WORD = "project string, track int, start double, end double, word string, language string, chunk int, flags array<string>, language_hint string"
ORDER = ["start", "end", "word", "chunk"]


def words(seed: int, n: int, track: int, steady: bool = False) -> list[tuple]:
    """Words with pauses, languages, sentence ends and words heard twice; ``steady`` has none of these."""
    r = np.random.RandomState(seed)
    at, out, language = 0.0, [], "en"
    for i in range(n):
        at = round(at + (0.35 if steady else 0.1 + r.rand() * 0.5 + (r.rand() < 0.03) * r.rand() * 4), 3)
        language = language if steady or r.rand() > 0.02 else ["en", "de", None][r.randint(3)]
        text = " same" if steady else " " + "abcdefghij"[: r.randint(1, 10)] + ("." if r.rand() < 0.08 else "")
        row = ("p", track, at, round(at + 0.3, 3), text, language, i // 40, ["Low"] if not steady and r.rand() < 0.1 else [], "fr" if not steady and r.rand() < 0.05 else None)
        out.append(row)
        if not steady and r.rand() < 0.1:
            out.append((*row[:2], round(at + 0.02, 3), round(at + 0.32, 3), row[4], language, i // 40 + 1, [], None))
    return out


def sequential(rows, rule, columns, order):
    place = [WORD_COLUMNS.index(c) for c in order]
    out, state, last = {}, None, None
    for row in sorted(rows, key=lambda x: (x[1], *(x[i] for i in place))):
        if row[1] != last:
            state, last = rule(), row[1]
        out.setdefault((row[1], row[2], row[4], row[6]), []).append(state(*(row[WORD_COLUMNS.index(c)] for c in columns)))
    return out


WORD_COLUMNS = [c.split()[0] for c in WORD.split(", ")]


@pytest.fixture
def spread(spark):
    """Small parts stay apart, so that a track lies in many."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def rows():
    return words(1, 6000, 1) + words(2, 40, 2) + words(3, 300, 3, steady=True) + words(4, 500, 4)


@pytest.mark.parametrize("rule", [sequence.WordCues, sequence.Fresh, sequence.Utterances, sequence.Blocks])
def test_split_tracks_fold_as_whole_ones(spread, rows, rule):
    table = spread.createDataFrame(rows, WORD).withColumn("text", F.col("word")).repartition(7)
    columns = [{"text": "word"}.get(c, c) for c in rule.columns]
    got = folds.numbered(table, ["project", "track"], ORDER, rule, "n")
    assert got.columns == [*table.columns, "n"]
    found = {}
    for r in got.collect():
        found.setdefault((r.track, r.start, r.word, r.chunk), []).append(r.n)
    assert found == sequential(rows, rule, columns, ORDER)


def test_a_hot_track_spreads(spread, rows):
    laid = ranges.laid(spread.createDataFrame(rows, WORD), ["project", "track"], ORDER)
    assert laid.filter("track = 1").select("_part").distinct().count() >= 12
    plan = folds.numbered(spread.createDataFrame(rows, WORD), ["project", "track"], ORDER, sequence.WordCues, "n")._jdf.queryExecution().toString()
    assert "Window" not in plan
    known = folds.segments(laid, ["project", "track"], sequence.WordCues, {})
    assert 12 <= known.count() <= 2 * 16
    one = ranges.laid(spread.createDataFrame(words(2, 40, 2), WORD).coalesce(1), ["track"], ORDER).withColumn("_part", F.lit(0).cast("long"))
    assert folds.segments(one, ["track"], sequence.WordCues, {}) is None


def test_only_borders_are_run_again(rows):
    """A second run of a segment stops where both runs agree."""
    ordered = sorted((r for r in rows if r[1] == 1), key=lambda r: (r[2], r[3], r[4], r[6]))
    first, calls = ordered[3000:6000], []

    class Counted(sequence.WordCues):
        def __call__(self, *row):
            calls.append(1)
            return super().__call__(*row)

    import pickle

    b = pd.DataFrame([(0, *(r[WORD_COLUMNS.index(c)] for c in Counted.columns)) for r in first], columns=["_first", *Counted.columns])
    guess = next(folds._ends(Counted, {})(iter([b.assign(_known=None)])))
    assert len(calls) == len(first)
    calls.clear()
    before = sequence.WordCues()
    for r in ordered[:3000]:
        before(*(r[WORD_COLUMNS.index(c)] for c in Counted.columns))
    known = pickle.dumps((pickle.dumps(before.state()), guess["state"][0], guess["begun"][0]))
    again = next(folds._ends(Counted, {})(iter([b.assign(_known=[known] + [None] * (len(b) - 1))])))
    assert len(calls) < len(first) // 10 and again["state"][0] == guess["state"][0]
    whole = sequence.WordCues()
    for r in ordered[:6000]:
        whole(*(r[WORD_COLUMNS.index(c)] for c in Counted.columns))
    assert before.number + int(again["begun"][0]) == whole.number


def test_cues_of_split_tracks(spread, rows):
    """Cues that go over the end of a segment are put together from pieces."""
    table = spread.createDataFrame(rows, WORD)
    got = {(r.track, r.cue): r for r in sequence.cues(table).collect()}
    want, state, last = {}, None, None
    for r in sorted(rows, key=lambda x: (x[1], x[2], x[3], x[4])):
        if r[1] != last:
            state, last = sequence.WordCues(), r[1]
        want.setdefault((r[1], state(r[2], r[3], r[5], r[4])), []).append(r)
    assert set(got) == set(want)
    for key, made in want.items():
        r = got[key]
        assert (r.start, r.end, r.n_words, r.language) == (made[0][2], max(made[0][2] + 0.12, made[-1][3]), len(made), made[0][5]) and r.text == "".join(x[4] for x in made).strip()
        fast = len(r.text) / max(0.12, made[-1][3] - made[0][2]) > 28
        assert r.flags == sorted({f for x in made for f in x[7]} | ({"Fast speech"} if fast else set())) and r.language_hints == sorted({x[8] for x in made if x[8]})


def test_cues_without_words_heard_twice(spread, rows):
    """One pass does what two do."""
    table = spread.createDataFrame(rows, WORD)
    one, two = sequence.cues(table, deduplicate=True), sequence.cues(sequence.dedup_words(table))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.agg(F.sum("n_words")).first()[0] < len(rows)


@pytest.mark.parametrize("whole", [0, 400, 10_000])
def test_small_tracks_take_one_shuffle_and_large_ones_are_split(spread, rows, monkeypatch, whole):
    """all tracks were sorted over ranges, written and shuffled again, and left a batch a track."""
    monkeypatch.setattr(folds, "WHOLE", whole)
    spread.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    table = spread.createDataFrame(rows + [("p", None, *r[2:]) for r in words(5, 30, 5)], WORD).repartition(7)
    try:
        got = folds.numbered(table, ["project", "track"], ORDER, sequence.FreshCues, "n")
        made = sequence.cues(table, deduplicate=True)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        laid = plan.count("RepartitionByExpression")
        found, cued = got.collect(), made.collect()
    finally:
        spread.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert laid == (1 if whole > 6000 else 2) and len(found) == len(rows) + len(words(5, 30, 5))
    kept, columns = {}, [WORD_COLUMNS.index(c) for c in sequence.FreshCues.columns]
    last, state = (), None
    for r in sorted([*rows, *[("p", None, *x[2:]) for x in words(5, 30, 5)]], key=lambda x: (x[1] or 0, x[2], x[3], x[4], x[6])):
        if (r[1],) != last:
            last, state = (r[1],), sequence.FreshCues()
        n = state(*(r[c] for c in columns))
        if n >= 0:
            kept.setdefault((r[1], n), []).append(r)
    want = {k: ("".join(r[4] for r in v).strip(), v[0][2], len(v), v[0][5], sorted({f for r in v for f in r[7]}), sorted({r[8] for r in v if r[8]})) for k, v in kept.items()}
    assert {(c.track, c.cue): (c.text, c.start, c.n_words, c.language, [f for f in c.flags if f != "Fast speech"], c.language_hints) for c in cued} == want and len(cued) == len(want)


@pytest.mark.parametrize("said", [1, 10_000_000])
def test_known_sizes_spare_a_count_and_change_nothing(spread, rows, said):
    """Words were made once more only to count them; a key said too large is split in vain."""
    table = spread.createDataFrame(rows, WORD)
    sizes = table.select("project", "track").distinct().withColumn("_n", F.lit(said).cast("long"))
    got, want = sequence.dedup_words(table, sizes), sequence.dedup_words(table)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    text = spread.createDataFrame([(None,), ("",), ("a b  c",), ("a",)], "text string")
    assert [r.n for r in text.select(F.coalesce(F.floor((F.length("text") + 1) / 2), F.lit(0)).alias("n")).collect()] == [0, 0, 3, 1]
