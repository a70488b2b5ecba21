"""Recovery in two passes against plain Python, with a recognizer that reads the samples."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cuelark.functions.scoring import repeats
from cuelark.operators import intervals, ranges, recovery
from cuelark.plans import inputs

# Python workers don't import the tests
cloudpickle.register_pickle_by_value(sys.modules[__name__])
RATE, WIDTH = 10, 3.0


class Reader:
    """Each stretch of equal samples is a word; negative numbers are words that are compressed, 99 is one said many times."""

    def __call__(self, samples, language):
        edges = np.flatnonzero(np.diff(samples, prepend=0, append=0))
        out = []
        for lo, hi in zip(edges, edges[1:]):
            n = int(samples[lo])
            if n:
                word = " na" * 9 if n == 99 else f" {abs(n)}"
                out.append((word, 3.0 if n < 0 else 1.0, 0.6 if n == 7 else 0.1, -0.9 if n == 8 else -0.2, [(word, lo / RATE - 0.05, hi / RATE + 0.2, 0.4 if n == 9 else 0.8)]))
        return out, "fr"


def plain(gaps, samples, duration, narrow=0.4, wide=2.0):
    out = []
    for number, (start, end) in enumerate(sorted(gaps)):

        def listen(margin, start=start, end=end):
            since, until = max(0.0, start - margin), min(duration, end + margin)
            segments, _ = Reader()(samples[round(since * RATE) : round(until * RATE)], None)
            words = []
            for _, compression, quiet, logprob, said in segments:
                for word, a, z, p in said:
                    a = max(0.0, min(until - since, a))
                    z = max(a, min(until - since, z))
                    doubts = [("Low confidence", p < 0.5 or logprob < -0.8), ("Possible non-speech", quiet > 0.5), ("Repetitive", compression > 2.4), ("Recovered", True), ("Unusual timing", z <= a or z - a > 2)]
                    words.append((word, since + a, since + z, [name for name, doubt in doubts if doubt]))
            return segments, [w for w in words if start <= (w[1] + w[2]) / 2 <= end]

        segments, words = listen(narrow)
        retried = any(s[1] > 2.4 or repeats(s[0]) for s in segments)
        if retried:
            _, words = listen(wide)
            if repeats("".join(w[0] for w in words)):
                words = []
        out.append((number, start, end, retried, "".join(w[0] for w in words), words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_recovery_against_plain_python(spark, seed):
    r = np.random.RandomState(seed)
    tracks, gaps, audio, lengths = {}, [], [], []
    for track in range(6):
        samples = np.repeat(r.choice([0, 0, 1, 2, 3, 7, 8, 9, -4, 99], 90), r.randint(1, 9, 90)).astype("float32")
        length = len(samples) / RATE
        cuts = np.round(np.sort(r.choice(np.arange(0, length, 0.5), 16, replace=False)), 2).reshape(-1, 2)
        tracks[track] = (cuts.tolist(), samples, length)
        gaps += [("p", track, float(a), float(z)) for a, z in cuts]
        size = round(WIDTH * RATE)
        audio += [("p", track, k, samples[k * size : (k + 1) * size].tolist()) for k in range(-(-len(samples) // size))]
        lengths.append(("p", track, float(length)))
    gaps.append((None, 9, 0.0, 1.0))
    lengths.append((None, 9, 1.0))
    keys = ["project", "track"]
    found = recovery.recover(
        spark.createDataFrame(gaps, "project string, track int, start double, end double"), spark.createDataFrame(audio, "project string, track int, piece int, samples array<float>"),
        spark.createDataFrame(lengths, "project string, track int, duration double"), keys, Reader, RATE, WIDTH,
    )
    rows = {(x.track, x.gap): x for x in found.collect()}
    want = {(t, row[0]): row for t, (cuts, samples, length) in tracks.items() for row in plain(cuts, samples, length)}
    assert set(rows) == {*want, (9, 0)} and rows[9, 0].text == "" and not rows[9, 0].retried
    for key, (_, start, end, retried, text, words) in want.items():
        x = rows[key]
        assert (x.start, x.end, x.retried, x.text) == (start, end, retried, text) and x.language == "fr"
        assert [(w.word, w.flags) for w in x.words] == [(w[0], w[3]) for w in words] and np.allclose([(w.start, w.end) for w in x.words], [w[1:3] for w in words])
    assert any(row[3] and row[4] for row in want.values()) and any(row[3] and not row[4] for row in want.values()) and any(not row[3] for row in want.values())
    words = recovery.recovered_words(found, keys).collect()
    assert len(words) == sum(len(row[5]) for row in want.values()) and all(w.chunk == -1 - next(g for (t, g), row in want.items() if t == w.track and row[1] <= (w.start + w.end) / 2 <= row[2]) for w in words)
    assert recovery.evidence(found, keys).columns == [*keys, "gap", "start", "end", "retried", "text"]


def test_a_missing_piece_of_audio_fails(spark):
    gap = spark.createDataFrame([(1, 0.0, 9.0)], "track int, start double, end double")
    audio = spark.createDataFrame([(1, k, [1.0] * 30) for k in (0, 2)], "track int, piece int, samples array<float>")
    with pytest.raises(Exception, match="a piece of audio is missing"):
        recovery.recover(gap, audio, spark.createDataFrame([(1, 9.0)], "track int, duration double"), ["track"], Reader, RATE, WIDTH)


def test_running_sums_of_one_hot_group(spark):
    """A group spreads over parts; its sums go on from part to part."""
    r = np.random.RandomState(3)
    rows = [("hot" if i % 4 else None if i % 8 else "cold", int(x), int(v) if v else None) for i, (x, v) in enumerate(zip(r.permutation(4000), r.randint(0, 50, 4000)))]
    table = spark.createDataFrame(rows, "pool string, at int, size long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = ranges.laid(table, ["pool"], ["at"])
        assert laid.filter("pool = 'hot'").select("_part").distinct().count() >= 3
        got = ranges.running(table, ["pool"], ["at"], {"total": F.col("size")})
        so_far, want = {}, {}
        for pool, at, size in sorted(rows, key=lambda x: x[1]):
            so_far[pool] = so_far.get(pool, 0) + (size or 0)
            want[pool, at] = so_far[pool]
        assert {(x.pool, x.at): x.total for x in got.collect()} == want
        places = ranges.placed(table, ["pool"], ["at"]).collect()
        assert sorted(x.place for x in places if x.pool is None) == list(range(sum(p is None for p, *_ in rows)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_audio_is_shuffled_however_small_it_looks(spark):
    """rows that explode into audio look small before, so that all of it was broadcast."""
    track = spark.createDataFrame([("a", 3)], "track string, n int")
    audio = track.select("track", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("piece")).select("track", "piece", F.array_repeat(F.col("piece").cast("float"), 30).alias("samples"))
    asked = spark.createDataFrame([("a", 0, 1.0, 7.0)], "track string, gap int, since double, until double")
    cut = recovery.slices(asked, audio, ["track"], RATE, WIDTH)
    rows = cut.collect()
    assert [list(r.samples) for r in rows] == [[0.0] * 20 + [1.0] * 30 + [2.0] * 10]
    assert "Broadcast" not in cut._jdf.queryExecution().executedPlan().toString()


def test_audio_is_made_once_for_both_passes(spark):
    """all audio was made and shuffled once a pass, though few gaps are heard again."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    pieces = [("a", k, [float(5 - 9 * (k % 2))] * 30) for k in range(8)]
    audio = spark.createDataFrame(pieces, "track string, piece int, samples array<float>").mapInArrow(counted, "track string, piece int, samples array<float>")
    gaps = spark.createDataFrame([("a", 1.0, 2.0), ("a", 4.0, 5.0)], "track string, start double, end double")
    found = recovery.recover(gaps, audio, spark.createDataFrame([("a", 24.0)], "track string, duration double"), ["track"], Reader, RATE, WIDTH)
    assert [(r.gap, r.retried, r.text) for r in found.orderBy("gap").collect()] == [(0, False, " 5"), (1, True, " 4")]
    assert made.value == len(pieces)


@pytest.mark.parametrize("rows", [3, 10_000])
def test_requests_across_blocks_and_batches(spark, monkeypatch, rows):
    """A request may begin in one block of audio and end in another; a block may go on in the next batch."""
    monkeypatch.setattr(recovery, "PIECES", 2)
    r, keys = np.random.RandomState(rows), ["project", "track"]
    sound = {(p, t): r.randint(0, 1000, n).astype("float32") for p, t, n in (("p", 0, 400), (None, 0, 95), ("p", 1, 30), (None, None, 121))}
    audio = [(p, t, k, x[k * 30 : k * 30 + 30].tolist()) for (p, t), x in sound.items() for k in range(-(-len(x) // 30))]
    spans = [(p, t, i, *sorted((r.randint(0, len(x) + 9, 2) / RATE).tolist())) for (p, t), x in sound.items() for i in range(40)] + [("none", 0, 0, 1.0, 2.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        made = spark.createDataFrame(audio, "project string, track int, piece int, samples array<float>"), spark.createDataFrame(spans, "project string, track int, gap int, since double, until double")
        got = recovery.slices(made[1], made[0], keys, RATE, WIDTH).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(p, t, i): sound.get((p, t), np.zeros(0))[round(a * RATE) : round(z * RATE)].tolist() for p, t, i, a, z in spans}
    assert {(x.project, x.track, x.gap): list(x.samples) for x in got} == want and len(got) == len(want)


def test_large_cuts_come_in_several_batches(spark):
    audio = spark.createDataFrame([(k,) for k in range(9)], "piece int").select(F.lit(1).alias("track"), "piece", F.array_repeat(F.col("piece").cast("float"), 100_000).alias("samples"))
    asked = spark.createDataFrame([(1, i, i * 1e4, i * 1e4 + 3e4) for i in range(7)], "track int, gap int, since double, until double")
    cut = recovery.slices(asked, audio, ["track"], RATE, 1e4).select("gap", F.size("samples").alias("n"), F.element_at("samples", 1).alias("first"), F.element_at("samples", -1).alias("last"))
    assert sorted(map(tuple, cut.collect())) == [(i, 300_000, float(i), i + 2.0) for i in range(7)]


def test_words_are_counted_without_splitting_texts(spark, tmp_path):
    """texts were split again for each use of their words; counts of white space say the same."""
    texts = ["a b", " a\t\tb\n", None, "", "  \n", "é ü x\x0b\x0cy\r", "\U0001f600   z", "one", "\x1fa \x1f", "ab " * 400]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    split = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    want = {r.doc_id: r.n for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", split.alias("n")).filter("n > 0").collect()}
    assert {r.track: r.n for r in inputs.word_counts(spark, str(tmp_path)).collect()} == want and len(want) == 7


def test_merged_runs_against_plain_python(spark):
    """Runs end at what all rows before the next one reach, also where rows are equal, empty or hold others."""
    r = np.random.RandomState(5)
    rows = [(t, int(a), int(a + n)) for t in range(30) for a, n in zip(r.randint(0, 60, t), r.randint(0, 9, t))]
    rows += [(100, 1, 2)] * 2 + [(101, 0, 50), (101, 3, 4), (101, 60, 61), (101, 60, 61), (102, 0, 9), (102, 9, 12), (102, 10, 11)]
    want = set()
    for t in {x[0] for x in rows}:
        runs = []
        for _, lo, hi in sorted(x for x in rows if x[0] == t):
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], hi)
            else:
                runs.append([lo, hi])
        want |= {(t, *run) for run in runs}
    got = intervals._merged(spark.createDataFrame(rows, "track int, lo long, hi long").repartition(3), ["track"]).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
