"""Streams with state: regrouped words, throttled messages, segments, against their batch forms."""

import json
import sys
import time

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cuelark.operators import sequence
from cuelark.sources import records
from cuelark.streaming import feeds, stateful

cloudpickle.register_pickle_by_value(sys.modules[__name__])
WORD = "project string, track int, start double, end double, word string, chunk int, language string, flags array<string>, language_hint string"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def words(seed: int, n: int = 400) -> list[tuple]:
    r = np.random.RandomState(seed)
    out = []
    for track in (1, 2, 3):
        at, language = 0.0, "en"
        for i in range(n if track < 3 else 5):
            at = round(at + 0.1 + r.rand() * 0.5 + (r.rand() < 0.04) * 1.5, 3)
            language = language if r.rand() > 0.02 else ["en", "de", None][r.randint(3)]
            word = (" " + "abcdef"[: r.randint(1, 6)] + "." * int(r.rand() < 0.1), i // 30, language, ["Low"] if r.rand() < 0.1 else [], "fr" if r.rand() < 0.1 else None)
            out.append(("p", track, at, round(at + 0.3 + (r.rand() < 0.01) * 3, 3), *word))
            if r.rand() < 0.15:
                out.append(("p", track, round(at + 0.03, 3), round(at + 0.33, 3), word[0], i // 30 + 1, language, [], None))
    return [out[i] for i in r.permutation(len(out))]


def batches(rows, tmp_path, sizes):
    folder = tmp_path / "in"
    folder.mkdir()
    names = [c.split()[0] for c in WORD.split(", ")]
    at = 0
    for i, n in enumerate(sizes):
        (folder / f"{i:03d}.json").write_text("\n".join(json.dumps(dict(zip(names, row))) for row in rows[at : at + n]))
        time.sleep(0.02)
        at += n
    assert at >= len(rows)
    return str(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_words_give_the_cues_of_all(rocksdb, tmp_path, seed):
    spark, rows = rocksdb, words(seed)
    source = batches(rows, tmp_path, [300, 1, 200, 7, 250, len(rows)])
    stream = spark.readStream.schema(WORD).option("maxFilesPerTrigger", 1).json(source)
    stored, sizes = [spark.createDataFrame([], stateful.PIECE)], []

    def sink(changed, _):
        changed = spark.createDataFrame(changed.collect(), changed.schema)
        sizes.append(changed.count())
        once = stateful.replace_pieces(stored[0], changed)
        stored[0] = spark.createDataFrame(stateful.replace_pieces(once, changed).collect(), changed.schema)

    stateful.cue_pieces(stream).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = sequence.cues(sequence.dedup_words(spark.createDataFrame(rows, WORD)))
    got = stateful.cues_of(stored[0])
    assert set(got.columns) == set(want.columns)
    order = ["track", "cue"]
    assert got.select(*want.columns).orderBy(*order).collect() == want.orderBy(*order).collect()
    assert sizes[1] < sizes[0] / 4  # one late word changes few pieces


@pytest.mark.parametrize("seed", range(12))
def test_pieces_touched_alone_are_enough(seed):
    """The processor on a plain dictionary: whatever the order and sizes of batches, the pieces are those of all words."""
    r = np.random.RandomState(seed)
    rows = [w[2:] for w in words(seed, 60) if w[1] == 1]
    rows = [(a, z, w, c, x, f, h) for a, z, w, c, x, f, h in rows]

    class Handle:
        def getValueState(self, *_):
            return self.Value()

        def getMapState(self, *_):
            return self.Map()

        class Value:
            value = None

            def exists(self):
                return self.value is not None

            def get(self):
                return self.value

            def update(self, value):
                self.value = value

        class Map(dict):
            getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__

    one = stateful.Regroup()
    one.init(Handle())
    stored: dict = {}
    while rows:
        n = r.randint(1, 12)
        now, rows = rows[:n], rows[n:]
        b = pd.DataFrame(now, columns=["start", "end", "word", "chunk", "language", "flags", "hint"])
        (out,) = one.handleInputRows(("p", 1), iter([b]), None)
        changed = out.astype(object).where(out.notna(), None).values.tolist()
        for piece in {c[2] for c in changed}:
            stored.pop(piece, None)
        for c in changed:
            if c[3] >= 0:
                stored.setdefault(c[2], []).append(tuple(c[3:9]))
    every = sorted([tuple(w[2:]) for w in words(seed, 60) if w[1] == 1], key=stateful._order)
    want = {p.words[0][0]: [c[:6] for c in p.cues()] for p in stateful.split(every)}
    flat = lambda x: [c[1:] for k in sorted(x) for c in x[k]]
    assert flat(stored) == flat(want) and list(one.index.get()[0]) == sorted(one.index.get()[0]) and {k[0] for k in one.pieces} == set(one.index.get()[0])


def test_messages_in_between_are_held_back(rocksdb, tmp_path):
    spark, source = rocksdb, tmp_path / "in"
    source.mkdir()
    r = np.random.RandomState(4)
    rows = [(k, round(float(a), 3), "st"[r.randint(2)], f"{k}{i}") for k in "ab" for i, a in enumerate(np.cumsum(r.rand(60) * 0.4))]
    lines = lambda part: "\n".join(json.dumps(dict(zip(("key", "at", "status", "message"), x))) for x in part)
    for i, lo in enumerate((0, 20, 40)):
        (source / f"{i}.json").write_text(lines([x for k in "ab" for x in [y for y in rows if y[0] == k][lo : lo + 20]]))
        time.sleep(0.02)
    seen = []
    stream = spark.readStream.schema("key string, at double, status string, message string").option("maxFilesPerTrigger", 1).json(str(source))
    query = stateful.throttled(stream, 0.5, True).writeStream.foreachBatch(lambda d, _: seen.extend(map(tuple, d.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        rule = {k: feeds.Throttle(0.5, True) for k in "ab"}
        want = [x[3] for x in rows if rule[x[0]](x[1], x[2])]
        until = time.time() + 90
        held = {max((x for x in rows if x[0] == k), key=lambda x: x[1])[3] for k in "ab"} - set(want)
        while time.time() < until and not ({x[3] for x in seen if not x[4]} >= {w for w in want if int(w[1:]) < 20} and {x[3] for x in seen} >= held and len({x[3] for x in seen}) >= len(want) // 2):
            time.sleep(0.5)
    finally:
        query.stop()
    first = lambda rows_: [m for m in rows_ if int(m[1:]) < 20]
    passed = [x[3] for x in seen if not x[4]]
    assert sorted(first(passed)) == sorted(first(want))  # no timer ran out before the first batch
    assert held <= {x[3] for x in seen} and len({x[3] for x in seen}) == len(seen)


def test_segments_are_taken_once(spark, tmp_path):
    schema = records.CHUNK + ", segment int, complete boolean"
    source = tmp_path / "in"
    source.mkdir()
    put = lambda name, *rows: (source / name).write_text("\n".join(json.dumps({"track": t, "segment": s, "raw_text": x, "complete": c, "languages": [{"start": s, "end": s + 1, "language": x, "score": 1}]}) for t, s, x, c in rows))
    put("0.json", (1, 0, "en", None), (1, 1, "de", None), (2, 0, "en", None), (1, 1, "de", None))
    segments = feeds.Segments(spark, str(tmp_path / "out"), schema)
    assert segments.table().count() == 0
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    segments.follow(read(), str(tmp_path / "c")).awaitTermination()
    put("1.json", (1, 1, "again", None), (1, 2, "fr", True), (2, 0, "again", None), (2, 1, "de", False))
    segments.follow(read(), str(tmp_path / "c")).awaitTermination()
    put("2.json", (1, 3, "after the end", None), (2, 2, "en", None))
    # a query that has lost its checkpoint sees all files again
    segments.follow(read(), str(tmp_path / "c2")).awaitTermination()
    segments.follow(read(), str(tmp_path / "c")).awaitTermination()
    got = sorted((r.track, r.segment, r.raw_text) for r in segments.table().collect())
    assert got == [(1, 0, "en"), (1, 1, "de"), (1, 2, "fr"), (2, 0, "en"), (2, 1, "de"), (2, 2, "en")]
    late = spark.createDataFrame([(2, 3, "last"), (2, 0, "again")], "track int, segment int, raw_text string").selectExpr("track", "0d as start", "1d as end", "raw_text", "cast(null as array<struct<start:double,end:double,language:string,score:double>>) as languages", "segment", "cast(null as boolean) as complete")
    for _ in range(2):  # a batch that is tried again
        segments.take(late, 7)
        assert sorted((r.track, r.segment, r.raw_text) for r in segments.table().collect()) == [*got, (2, 3, "last")]
    timelines = {r.track: [x.language for x in r.timeline] for r in records.language_timeline(segments.table().filter("segment < 3").withColumn("file", F.format_string("%06d", "segment"))).collect()}
    assert timelines == {1: ["en", "de", "fr"], 2: ["en", "de", "en"]}


def test_pull_progress(spark):
    lines = spark.createDataFrame([("m", 1, '{"status": "pulling", "completed": 5, "total": 20}'), ("m", 2, '{"status": "done"}'), ("m", 3, ""), ("m", 4, "no json"), ("m", 5, '{"error": "full"}')], "key string, at int, value string")
    got = {r.at: (r.status, r.progress, r.error) for r in records.pull_progress(lines).collect()}
    assert got == {1: ("pulling", 0.25, None), 2: ("done", 0.0, None), 4: ("Downloading", 0.0, "unreadable: no json"), 5: ("Downloading", 0.0, "full")}
