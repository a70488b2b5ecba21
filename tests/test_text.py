import random

import pytest
from pyspark.sql import functions as F

from cuelark.functions import scoring, text


def one(spark, column, *values):
    return spark.createDataFrame([values], [f"v{i}" for i in range(len(values))]).select(column.alias("x")).first().x


@pytest.mark.parametrize("seconds,shown", [(3600.9996, "01:00:01,000"), (0.0005, "00:00:00,000"), (0.0015, "00:00:00,002"), (-5.0, "00:00:00,000"), (360000.25, "100:00:00,250")])
def test_timestamp(spark, seconds, shown):
    assert one(spark, text.timestamp(F.col("v0")), seconds) == shown


def test_clock(spark):
    assert one(spark, text.clock(F.col("v0")), "01:02:03.004") == 3723.004
    assert one(spark, text.clock(F.col("v0")), "1:2:3") is None


@pytest.mark.parametrize("tag,code", [("eng", "en"), ("ger", "de"), ("fr_FR", "fr"), ("PT-BR", "pt"), ("klingon", "und"), ("xx", "xx")])
def test_language_code(spark, tag, code):
    assert one(spark, text.language_code(F.col("v0")), tag) == code


def test_language_tables(spark):
    assert len(text.CODES2) == len(text.CODES3) == len(text.NAMES) == 54
    assert one(spark, text.language_tag(F.col("v0")), "fa") == "fas"
    assert one(spark, text.language_name(F.col("v0")), "ja") == "Japanese"
    assert one(spark, text.language_name(F.col("v0")), "zz") == "zz"


def test_markup(spark):
    raw = "{\\an8}<i>Hello</i><br/>there &amp; <b class='x'>you</b> <name>"
    assert one(spark, text.unescape(text.without_markup(F.col("v0"))), raw) == "Hello\nthere & you <name>"


def test_sentence_end(spark):
    assert one(spark, text.ends_sentence(F.col("v0")), " done。 ")
    assert one(spark, text.ends_sentence(F.col("v0"), True), "done.” ")
    assert not one(spark, text.ends_sentence(F.col("v0"), True), "done, ")


def test_wrapped(spark):
    long = "word " * 20 + "x" * 60 + " well-known"
    lines = one(spark, text.wrapped(F.col("v0")), long).split("\n")
    assert max(len(x) for x in lines if "xx" not in x) <= 46 and "x" * 60 in lines


def test_keys(spark):
    import hashlib

    assert one(spark, text.stable_id(F.col("v0"), F.col("v1"), F.col("v2"), F.col("v3")), "p", 3, 12.345, 7) == hashlib.sha256(b"p:3:12.345:7").hexdigest()[:20]
    a = one(spark, text.signature(F.col("v0"), F.col("v1")), "x", 1)
    assert a != one(spark, text.signature(F.col("v0"), F.col("v1")), "x", 2) and len(a) == 64


def test_ranges(spark):
    r = one(spark, text.preview_range(F.col("v0"), F.col("v1"), F.col("v2")), -3.0, 100.0, 40.0)
    assert (r.start, r.duration) == (0.0, 40.0)
    assert one(spark, text.preview_range(F.col("v0"), F.col("v1"), F.col("v2")), 50.0, 5.0, 40.0) is None
    r = one(spark, text.processed_range(F.col("v0"), F.lit(None).cast("double"), F.col("v1")), 10.0, 40.0)
    assert (r.begin, r.end) == (10.0, 40.0)
    with pytest.raises(Exception, match="holds nothing"):
        one(spark, text.processed_range(F.col("v0"), F.lit(5.0), F.col("v1")), 50.0, 40.0)


def test_small_rules(spark):
    assert one(spark, text.confidence(F.col("v0")), -0.5) == pytest.approx(0.60653066)
    assert one(spark, text.confidence(F.col("v0")), 7.0) == 1.0
    assert one(spark, text.extension(F.col("v0")), "/a/b.c/Clip.MKV") == ".mkv"
    assert one(spark, text.extension(F.col("v0")), "/a.b/clip") == ""
    assert one(spark, text.url_name(F.col("v0")), "a b+é") == "a%20b%2B%C3%A9"
    assert one(spark, text.human_duration(F.col("v0")), 3725.0) == "1:02:05"
    assert one(spark, text.remaining(F.col("v0"), F.col("v1")), 30.0, 0.25) == 90.0
    assert one(spark, text.noise_scale(F.col("v0"), F.col("v1"), F.col("v2")), 1.0, 0.5, 20.0) == pytest.approx(0.2)
    assert "Persian (fa)" in one(spark, text.translation_prompt(F.col("v0"), F.lit("en"), F.lit("salam")), "fa")


def test_scoring(spark):
    rows = [("one two three", "one too three um uh hm", 3 - 2, 1 + 3, 0), ("كتاب ي ١٢", "کتاب ی 12", 0, 0, 0), ("", "a b", 0, 2, 0), ("a b c", "", 0, 0, 3)]
    got = scoring.score(spark.createDataFrame([(a, b) for a, b, *_ in rows], "reference string, hypothesis string")).collect()
    assert [(g.substitutions, g.insertions, g.deletions) for g in got[1:]] == [(0, 0, 0), (0, 2, 0), (0, 0, 3)]
    assert got[0].edits == got[0].substitutions + got[0].insertions + got[0].deletions == 4
    assert all(g.matches == g.reference_words - g.substitutions - g.deletions for g in got)


def test_published_error_rates(spark):
    """Edit counts of four published runs, and the rates they give."""
    runs = [(920, 2664, 34.53), (941, 2664, 35.32), (71, 1365, 5.20), (68, 1365, 4.98)]
    for edits, reference, percent in runs:
        assert one(spark, scoring.error_rate(F.col("v0"), F.col("v1")), edits, reference) == pytest.approx(percent / 100, abs=1e-4)


def test_units_and_distance(spark):
    assert scoring.units_of("日本 語", "ja") == ["日", "本", "語"]
    assert scoring.units_of("می‌روم ي", "fa") == ["می", "روم", "ی"]
    r = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "b", "c"])], "a array<string>, b array<string>").select(scoring.distance("a", "b").alias("d")).first()
    assert r.d == 1


def test_distance_matches_plain_table():
    import random

    random.seed(1)
    for _ in range(200):
        a, b = ([random.choice("xyz") for _ in range(random.randint(0, 8))] for _ in range(2))
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert scoring.compare(a, b)["edits"] == d[len(a), len(b)]


@pytest.mark.parametrize("value,loops", [("no " * 8, True), ("no " * 7, False), ("a b " * 4, True), ("a b c " * 4 + "d", True), ("a b c d e f g h", False), ("one two three four " + "x " * 6, True), (None, False)])
def test_repetitive(spark, value, loops):
    row = spark.createDataFrame([(value,)], "t string").select(scoring.repetitive("t").alias("x")).first()
    assert row.x is loops


def test_long_texts_are_compared_in_little_memory():
    import random

    from cuelark.functions import scoring

    r = random.Random(3)
    a = [f"w{r.randint(0, 50)}" for _ in range(3000)]
    b = [x for x in a if r.random() > 0.1] + ["end"] * 7
    m = scoring.compare(a, b)
    assert m["edits"] == scoring.edits(a, b) == m["substitutions"] + m["deletions"] + m["insertions"]
    assert m["matches"] + m["substitutions"] + m["deletions"] == 3000 and m["matches"] + m["substitutions"] + m["insertions"] == len(b)
    assert scoring.edits([], ["x"]) == 1 and scoring.edits(["x"], []) == 1 and scoring.compare([], ["x"])["insertions"] == 1


def test_shares_of_translations():
    from cuelark.operators.sequence import cut_points, shares

    assert shares("one two three four", [1.0, 1.0], "de") == ["one two", "three four"]
    assert shares("a b c", [9.0, 0.0, 0.0], "de") == ["a", "b", "c"] and shares("a b", [1.0] * 3, "de") is None and shares("?! ...", [1.0], "de") is None
    assert shares("東京、AB 大阪。", [1.0, 1.0], "ja") == ["東京、", "AB 大阪。"] and shares("x", [], "de") is None

    def clamped(durations, n):  # the rule, an end at a time
        weights = [max(0.1, d) for d in durations]
        out, passed, at = [], 0.0, 0
        for i, w in enumerate(weights):
            passed += w
            left = len(weights) - i - 1
            at = max(at + 1, min(round(n * passed / sum(weights)), n - left)) if left else n
            out.append(at)
        return out

    import random

    r = random.Random(1)
    for _ in range(2000):
        d = [r.choice([0.0, 0.1, 1.0, 7.5]) for _ in range(r.randint(1, 7))]
        n = r.randint(len(d), 20)
        assert cut_points(d, n).tolist() == clamped(d, n), (d, n)


def test_long_texts_are_compared_in_little_time():
    """a table of 20,000 times 17,143 tokens, cell by cell, took seconds."""
    import time

    a = [str(i % 900) for i in range(20_000)]
    b = [w for i, w in enumerate(a) if i % 7 != 6]
    begin = time.process_time()
    assert scoring.edits(a, b) == 20_000 // 7
    assert time.process_time() - begin < 0.9


def test_a_batch_of_word_lists_takes_little_python_memory():
    """F4, F8: lists of a whole batch were Python texts at one time."""
    import tracemalloc

    import pyarrow as pa

    words = pa.array([[f"w{i}x{j}" for j in range(100)] for i in range(4000)])
    fewer = pa.array([[f"w{i}x{j}" for j in range(100) if j % 10] for i in range(4000)])
    texts = pa.array([" ".join(row) for row in words.to_pylist()])
    for made in (lambda: scoring.distance.func(words, fewer).to_pylist() == [10] * 4000, lambda: scoring.tokens.func(texts).equals(words)):
        tracemalloc.start()
        assert made()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 8e6


def test_long_texts_are_never_lists_all_at_one_time():
    """F8: 256 rows were lists of Python texts at one time whatever their length, and words were lists where only their number was asked for."""
    import tracemalloc

    import pyarrow as pa

    words = pa.array([[f"w{i}x{j}" for j in range(10_000)] for i in range(100)])
    texts = pa.array([" ".join(row) for row in words.to_pylist()])
    one = pa.array([" ".join(texts.to_pylist()[:40])])
    for made, most in (
        (lambda: scoring.tokens.func(texts).equals(words), 16e6),
        (lambda: scoring.units.func(texts, pa.array(["en"] * 100)).equals(words), 16e6),
        (lambda: scoring.token_count.func(texts).to_pylist() == [10_000] * 100, 1e6),
        (lambda: scoring.token_count.func(one).to_pylist() == [400_000], 10e6),
    ):
        tracemalloc.start()
        assert made()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most


def test_only_numbers_of_words_come_back_from_python(spark):
    """F8: nfkc_words got all words as lists from Python, for their number alone."""
    from cuelark.plans import catalog

    d = "/root/testdata/sf0.001"
    df = catalog.QUERIES["nfkc_words"](spark, d)
    want = {r.doc_id: len(scoring.tokens_of(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: r.tokens for r in df.collect()} == want and df.schema["tokens"].dataType.simpleString() == "int"
    assert "size(" not in df._jdf.queryExecution().optimizedPlan().toString()
    odd = ["A b", None, "", "é١ x_y", "ﬁne ﷺ", "می‌روم كتاب", "e\u0301a", "ـ", "１２ ３", "日本 語", "İ ß ǅ"]
    table = spark.createDataFrame([(t,) for t in odd], "t string").coalesce(1)
    assert [tuple(r) for r in table.select("t", scoring.token_count("t"), F.size(scoring.tokens("t"))).collect()] == [(t, n, n) for t in odd for n in [len(scoring.tokens_of(t))]]
    assert scoring.tokens.func(pa_texts := table.select("t").toArrow().column(0).combine_chunks().slice(3, 4)).to_pylist() == [scoring.tokens_of(t) for t in pa_texts.to_pylist()]


def test_lists_of_words_with_nulls_and_slices(spark):
    rows = [(["a", None, "b"], ["a", "b"]), (None, ["a"]), ([], ["x"]), (["q"], None), (["a", None], ["a", None])]
    table = spark.createDataFrame(rows, "a array<string>, b array<string>").coalesce(1)
    assert [r.d for r in table.select(scoring.distance("a", "b").alias("d")).collect()] == [1, None, 1, None, 0]
    long = spark.range(3000).coalesce(1).select(F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda x: x.cast("string")).alias("a"), F.col("id"))
    assert [r.d for r in long.filter("id % 3 > 0").orderBy("id").select(scoring.distance("a", F.array(F.lit("0"))).alias("d")).collect()] == [i % 5 for i in range(3000) if i % 3]
    assert [r.t for r in spark.createDataFrame([("A b",), (None,), ("",), ("é١ x_y",)], "t string").coalesce(1).select(scoring.tokens("t").alias("t")).collect()] == [["a", "b"], [], [], ["é1", "x", "y"]]


def test_edits_near_the_diagonal():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    draw = random.Random(3)
    for _ in range(400):
        a = [draw.randrange(draw.choice([2, 5, 50])) for _ in range(draw.randrange(40))]
        b = [x for x in a if draw.random() > 0.1 for x in [draw.randrange(50) if draw.random() < 0.1 else x] * (1 + (draw.random() < 0.1))]
        want = plain(a, b)
        assert scoring.edits(a, b) == scoring.edits(b, a) == want
        long, short = sorted((a, b), key=len, reverse=True)
        for most in range(len(long) - len(short), len(long) + 1):
            assert scoring._near(long, short, most) == (want if want <= most else None)


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    """A worker never holds many long texts at once, however many there are."""
    from pyspark.sql import functions as F

    from cuelark.plans import inputs

    spark.range(0, 64, 1, 1).select(F.repeat(F.lit("word "), 100_000).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    got = inputs.table(spark, str(tmp_path), "documents").coalesce(1).mapInArrow(sizes, "n long").collect()
    assert max(r.n for r in got) < 6_000_000 and sum(r.n for r in got) > 30_000_000


def test_words_left_out_need_no_columns(monkeypatch):
    def never(*_):
        raise AssertionError("columns were made")

    monkeypatch.setattr(scoring, "_near", never)
    monkeypatch.setattr(scoring, "_columns", never)
    a = [i % 11 for i in range(50_000)]
    b = [x for i, x in enumerate(a) if i % 7 != 6]
    assert scoring.edits(a, b) == scoring.edits(b, a) == len(a) - len(b)
