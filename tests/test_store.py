"""Snapshots with several writers, results computed once, and folds as SQL."""

import threading

import pytest
from pyspark.sql import functions as F

from cuelark import sql
from cuelark.operators import sequence, store

ROW = "project string, id int, text string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def test_a_broken_write_leaves_the_old_version(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), patience=0.2)
    for n in range(3):
        s.write("t", spark.range(n + 1))
    (tmp_path / "t" / "versions" / "000000000009").touch()  # claimed, and never filled
    assert s.read("t", "id long").count() == 3
    s.write("t", s.read("t", "id long").filter("id > 0"))
    assert s.read("t", "id long").count() == 2 and s.read("none", "id long").count() == 0
    assert s.newest("t")[0] == 10


def test_only_one_writer_gets_a_version(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.write("t", spark.range(1))
    with pytest.raises(store.Conflict):
        s._claim("t", 0, {})
    won, together = [], threading.Barrier(6)

    def claim(i):
        together.wait()
        try:
            s._claim("t", 1, {"manifest": str(i), "column": None, "snapshots": []})
            won.append(i)
        except store.Conflict:
            pass

    threads = [threading.Thread(target=claim, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and s.newest("t") == (1, {"manifest": str(won[0]), "column": None, "snapshots": []})


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    """Each reads, adds its row and writes, all at once."""
    s = store.Store(spark, str(tmp_path))
    s.write("t", rows(spark, ("p", 0, "first")))
    errors = []

    def add(i):
        try:
            s.change("t", ROW, lambda old: old.unionByName(rows(spark, ("p", i, "added"))))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(1, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(r.id for r in s.read("t", ROW).collect()) == [0, 1, 2, 3] and s.newest("t")[0] == 3


def test_changes_of_other_partitions_stand(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.write("t", rows(spark, ("a", 1, "x"), ("b", 2, "x"), (None, 3, "x"), ("7", 4, "x")), ["project"], ["id"])
    calls, meanwhile = [], []

    def change(text, other=None):
        def f(old):
            calls.append(text)
            if other and not meanwhile:
                meanwhile.append(1)
                other()
            return old.withColumn("text", F.lit(text))

        return f

    s.change_partitions("t", ROW, "project", ["a"], change("mine", lambda: s.change_partitions("t", ROW, "project", ["b", None], change("theirs"))))
    want = {("a", 1, "mine"), ("b", 2, "theirs"), (None, 3, "theirs"), ("7", 4, "x")}
    assert {tuple(r) for r in s.read("t", ROW).collect()} == want and calls == ["mine", "theirs"]  # no partition in common: nothing done twice
    meanwhile.clear(), calls.clear()
    s.change_partitions("t", ROW, "project", ["a"], change("later", lambda: s.change_partitions("t", ROW, "project", ["a", "b"], change("between"))))
    assert {tuple(r) for r in s.read("t", ROW).collect()} == {("a", 1, "later"), ("b", 2, "between"), (None, 3, "theirs"), ("7", 4, "x")} and calls == ["later", "between", "later"]
    assert len(list((tmp_path / "t" / "data").iterdir())) > 3 and s.clean("t", 1) >= 2
    s.change_partitions("t", ROW, "project", ["b"], lambda old: old.limit(0))
    s.change_partitions("t", ROW, "project", ["new"], lambda old: rows(spark, ("new", 9, "n")))
    assert {r.project for r in s.read("t", ROW).collect()} == {"a", None, "7", "new"}
    with pytest.raises(ValueError, match="other partitions"):
        s.change_partitions("t", ROW, "project", ["a"], lambda old: rows(spark, ("z", 1, "z")))


def test_replaced_tracks_touch_one_project(spark, tmp_path):
    """Edits survive a replacement that reads and writes the project alone."""
    cue = lambda project, i, text, edited: (i, project, 1, 0.0, 1.0, text, text, "en", [], False, edited)
    s = store.Store(spark, str(tmp_path))
    s.write("cues", spark.createDataFrame([cue("p", "a", "mine", True), cue("p", "b", "old", False), cue("q", "c", "old", False)], store.CUE), ["project"], ["start"])
    new = spark.createDataFrame([cue("p", "a", "new", False), cue("p", "d", "new", False)], store.CUE)
    before = {p.name for p in (tmp_path / "cues" / "data").iterdir()}
    s.change_partitions("cues", store.CUE, "project", ["p"], lambda old: store.replace_cues(old, new))
    assert {(r.project, r.id, r.text) for r in s.read("cues", store.CUE).collect()} == {("p", "a", "mine"), ("p", "d", "new"), ("q", "c", "old")}
    (made,) = {p.name for p in (tmp_path / "cues" / "data").iterdir()} - before
    assert [p.name for p in (tmp_path / "cues" / "data" / made).glob("project=*")] == ["project=p"]


def test_results_are_computed_once(spark, tmp_path):
    results, calls = store.Results(spark, str(tmp_path)), []

    def make(n=3):
        def run():
            calls.append(n)
            return spark.range(n)

        return run

    meta = {"fingerprint": "f", "track": 1, "version": 2}
    assert results.get("audio", meta, make()).count() == 3 and results.get("audio", dict(reversed(meta.items())), make()).count() == 3 and calls == [3]
    assert results.get("audio", meta | {"version": 3}, make(4)).count() == 4 and calls == [3, 4]
    marker = next(p for p in (tmp_path / "audio").glob("*/marker.json") if '"version": 2' in p.read_text())
    marker.unlink()  # cut off before it was whole
    assert results.get("audio", meta, make(5), rows=5).count() == 5 and calls == [3, 4, 5]
    marker.write_text('{"version"')
    with pytest.raises(ValueError, match="6 rows instead of 7"):
        results.get("audio", meta, make(6), rows=7)
    assert not marker.exists() and results.get("audio", meta, make(7), rows=7).count() == 7


@pytest.mark.parametrize(("name", "form", "order"), [("group_words", sequence.group_words, "start, `end`, word"), ("group_cues", sequence.utterances, "start, `end`, id"), ("cue_blocks", sequence.transcript_blocks, "start, `end`, id")])
def test_folds_in_sql(spark, name, form, order):
    sql.register(spark)
    table = spark.createDataFrame([("p", t, i * 0.7, i * 0.7 + 0.5 + (i % 11 == 0) * 2, f" w{i}" + "." * (i % 9 == 0), "de" if i % 50 > 40 else "en", f"id{i:04d}") for t in (1, 2) for i in range(150)], "project string, track int, start double, end double, word string, language string, id string").withColumn("text", F.col("word"))
    table.createOrReplaceTempView("rows_of_" + name)
    got = spark.sql(f"select * from {name}(table(rows_of_{name}) partition by (project, track) order by ({order}))")
    want = form(table)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="expected TABLE"):
        spark.sql(f"select * from {name}(table(select 1 as x) partition by x)").collect()


def test_words_heard_twice_in_sql(spark):
    sql.register(spark)
    words = spark.createDataFrame([("p", 1, 1.0, 1.3, " a", 0), ("p", 1, 1.05, 1.3, " a", 1), ("p", 1, 2.0, 2.3, " a", 1), ("p", 2, 1.0, 1.3, " a", 0)], "project string, track int, start double, end double, word string, chunk int")
    words.createOrReplaceTempView("heard")
    got = spark.sql("select * from deduplicate(table(heard) partition by (project, track) order by (start, `end`, word, chunk)) where fresh = 1").drop("fresh")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sequence.dedup_words(words).collect())) and got.count() == 3
