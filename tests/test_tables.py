import pytest
from pyspark.sql import functions as F

from cuelark.functions import seams
from cuelark.operators import media, signal, store, tracks
from cuelark.sources import records, subtitles
from cuelark.streaming import feeds

CUE = "id string, project string, track int, start double, end double, text string, raw_text string, language string, flags array<string>, reviewed boolean, edited boolean"


def cue(i, text="words", track=0, **more):
    base = dict(id=i, project="p", track=track, start=float(ord(i[0]) - 97) * 2, end=float(ord(i[0]) - 97) * 2 + 1, text=text, raw_text=text, language="en", flags=[], reviewed=False, edited=False)
    return tuple((base | more).values())


def test_replace_keeps_edits(spark):
    old = spark.createDataFrame([cue("a", "mine", edited=True), cue("b", "old"), cue("z", "other track", track=9)], CUE)
    new = spark.createDataFrame([cue("a", "new"), cue("b", "new"), cue("c", "new")], CUE)
    got = {r.id: (r.text, r.raw_text) for r in store.replace_cues(old, new).collect()}
    assert got == {"a": ("mine", "new"), "b": ("new", "new"), "c": ("new", "new"), "z": ("other track", "other track")}


def test_update_is_checked(spark):
    old = spark.createDataFrame([cue("a"), cue("b")], CUE)
    change = "id string, text string, start double, end double, reviewed boolean"
    got = {r.id: r for r in store.update_cues(old, spark.createDataFrame([("a", None, None, None, True)], change)).collect()}
    assert got["a"].reviewed and not got["a"].edited
    with pytest.raises(Exception, match="invalid cue"):
        store.update_cues(old, spark.createDataFrame([("a", None, 5.0, 5.0, None)], change)).collect()


def test_store_snapshots(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.read("cues", CUE).count() == 0
    first = spark.createDataFrame([cue("a"), cue("b", track=1)], CUE)
    s.write("cues", first, ["project"], ["track", "start"])
    s.write("cues", store.upsert(s.read("cues", CUE), spark.createDataFrame([cue("a", "again")], CUE), ["id"]))
    assert {r.id: r.text for r in s.read("cues", CUE).collect()} == {"a": "again", "b": "words"}


def test_create_project_keeps_identity(spark):
    shape = "id string, fingerprint string, name string, created double, audio_tracks array<int>"
    old = spark.createDataFrame([("1", "f", "a.mkv", 1.0, [1, 2])], shape)
    got = {r.id: r for r in store.create_project(old, spark.createDataFrame([("9", "f", "b.mkv", 5.0, []), ("2", "g", "c.mkv", 6.0, [3])], shape)).collect()}
    assert got["1"].name == "b.mkv" and got["1"].audio_tracks == [1, 2] and got["1"].created == 1.0 and set(got) == {"1", "2"}


def test_migrate_and_restart(spark):
    old = spark.createDataFrame([("a", ["Check translation", "x"], "s")], "id string, flags array<string>, speaker string")
    got = store.migrate(old).first()
    assert got.flags == ["Check wording", "x"] and got.reviewed is False and "speaker" not in got.asDict()
    jobs = spark.createDataFrame([("1", "running"), ("2", "done")], "id string, status string")
    assert {r.id: r.status for r in store.after_restart(jobs).collect()} == {"1": "paused", "2": "done"}


def test_cache_validity(spark):
    c = spark.createDataFrame([("k", 5, ("a",)), ("l", 5, ("a",)), ("m", 4, ("a",))], "key string, size long, metadata struct<v:string>")
    w = spark.createDataFrame([("k", 5, ("a",)), ("l", 5, ("b",)), ("m", 5, ("a",))], "key string, size long, metadata struct<v:string>")
    assert [r.key for r in store.still_cached(c, w).collect()] == ["k"]


def test_valid_translations_need_the_whole_group(spark):
    rows = [cue("a", "Hello", start=0.0, end=1.0), cue("b", "there.", start=1.1, end=2.0), cue("c", "Alone", start=9.0, end=10.0)]
    cues = spark.createDataFrame(rows, CUE)
    saved = tracks.signed(cues).select(F.col("id").alias("cue_id"), F.lit("t").alias("text"), F.col("text").alias("source_text"), F.lit(2).alias("version"), F.lit("m").alias("model_digest"), tracks.group_signature(F.lit("de"), F.lit("m")).alias("source_signature"))
    saved = spark.createDataFrame(saved.collect(), saved.schema)
    assert {r.cue_id for r in tracks.valid_translations(cues, saved, "de").collect()} == {"a", "b", "c"}
    changed = cues.withColumn("text", F.when(F.col("id") == "b", F.lit("here.")).otherwise(F.col("text")))
    assert {r.cue_id for r in tracks.valid_translations(changed, saved, "de").collect()} == {"c"}
    assert tracks.valid_translations(cues, saved, "fr").count() == 0


def test_predicates(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3]), ([1, 1], [1]), ([4], [1])], "asked array<int>, there array<int>")
    assert [r[0] for r in df.select(tracks.valid_choice(F.col("asked"), F.col("there"))).collect()] == [True, False, False]
    words = spark.createDataFrame([(0.4, -0.1, 0.1, 1.0, 0.0, 3.0)], "p double, l double, n double, c double, s double, e double")
    assert words.select(tracks.word_flags(*[F.col(c) for c in "plncse"])).first()[0] == ["Low confidence", "Unusual timing"]
    tracks_ = spark.createDataFrame([([(1, "a"), (2, "b")],)], "t array<struct<stream_index:int,name:string>>")
    got = tracks_.select(tracks.replaced_track(F.col("t"), F.lit(2), F.struct(F.lit(2).alias("stream_index"), F.lit("new").alias("name")))).first()[0]
    assert [x.name for x in got] == ["a", "new"]


def test_srt_round_trip(spark):
    body = "\ufeff1\r\n00:00:07,250 --> 00:00:09,900\r\n<b>Where</b> to?\r\n\r\n2\r\n02:10:11.120 --> 02:10:12,000 X1:10\r\nsalt &amp; pepper &gt; sugar\r\n\r\n3\r\n03:00:00,000 --> 03:00:01,000\r\n{\\an8}\r\n"
    files = spark.createDataFrame([("p", 1, "en", body)], "project string, track int, language string, text string")
    got = subtitles.read_srt(files).orderBy("start").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(7.25, 9.9, "Where to?"), (7811.12, 7812.0, "salt & pepper > sugar")]
    text = subtitles.srt_text(subtitles.read_srt(files)).first().text
    assert text.startswith("1\n00:00:07,250 --> 00:00:09,900\nWhere to?\n\n2\n02:10:11,120")
    bad = spark.createDataFrame([("p", 1, "en", "1\nnot a time\nx")], files.schema)
    with pytest.raises(Exception, match="unreadable"):
        subtitles.read_srt(bad).collect()


def test_transcripts(spark):
    rows = [("p", 0, "a", 0.0, 1.0, "fa", "Salam", "Hi"), ("p", 0, "b", 9.0, 10.0, "fa", "Khoob", "Good")]
    c = spark.createDataFrame(rows, "project string, track int, id string, start double, end double, language string, text string, translated_text string")
    assert subtitles.transcript_text(c).first().text == "Salam\n\nKhoob\n"
    assert subtitles.transcript_text(c, "translated").first().text == "Hi\n\nGood\n"
    assert subtitles.transcript_text(c, "parallel").first().text.startswith("Original (Persian)\nSalam\n\nEnglish\nHi")
    with pytest.raises(Exception, match="stale"):
        subtitles.transcript_text(c.withColumn("translated_text", F.lit(None).cast("string")), "translated").collect()
    with pytest.raises(Exception, match="stale"):
        subtitles.srt_text(c.withColumn("translated_text", F.lit(None).cast("string")), True).collect()


def test_media(spark):
    body = '{"format":{"duration":"0"},"streams":[{"index":0,"codec_type":"video","codec_name":"h264","duration":"12.5"},{"index":1,"codec_type":"video","disposition":{"attached_pic":1}},{"index":2,"codec_type":"audio"},{"index":3,"codec_type":"audio"},{"index":4,"codec_type":"subtitle"}]}'
    probes = spark.createDataFrame([("/a.mkv", body)], "path string, body string")
    assert sorted((r.codec_type, r["index"], r.ordinal) for r in media.streams(probes).collect()) == [("audio", 2, 0), ("audio", 3, 1), ("subtitle", 4, 0), ("video", 0, 0)]
    assert media.durations(probes).first().duration == 12.5


def test_listing(spark, tmp_path):
    rows = [("b.MKV", "/b", "file", 1), ("A", "/A", "folder", 0), ("ä.mp4", "/c", "file", 1), ("n.txt", "/d", "file", 1)]
    got = media.list_files(spark.createDataFrame(rows, "name string, path string, kind string, size long"), [".mkv", ".mp4"]).collect()
    assert [r.name for r in got] == ["A", "b.MKV", "ä.mp4"] and got[0].total == 3 and got[0].skipped == 1
    f = tmp_path / "x"
    f.write_bytes(b"abc")
    files = spark.createDataFrame([(str(f), 3, 1), ("/no/such", 3, 1)], "p string, s long, m long").select(media.file_fingerprint("p", "s", "m").alias("x")).collect()
    assert len(files[0].x) == 64 and files[1].x is None


def test_signal(spark):
    df = spark.createDataFrame([(1, [0.1, -0.5, 0.2, 0.25])], "track int, samples array<float>")
    assert [(r.block, r.peak) for r in signal.peaks(df, "track", most=2).orderBy("block").collect()] == [(0, 0.5), (1, 0.25)]
    assert df.select(signal.rms(F.col("samples"))).first()[0] == pytest.approx(0.3010, abs=1e-3)
    assert max(map(abs, df.select(signal.normalized(F.col("samples"))).first()[0])) == 1.0
    assert df.select(signal.sampling_positions(F.lit(10.0))).first()[0] == [0.0]


def test_records(spark, tmp_path):
    for n, x in (("000", "en"), ("001", "de"), ("002", "en")):
        (tmp_path / f"{n}.json").write_text('{"track":1,"start":0,"end":1,"raw_text":"x","languages":[{"start":0,"end":1,"language":"%s","score":1}]}' % x)
    got = records.language_timeline(records.read_chunks(spark, f"{tmp_path}/*.json")).first()
    assert [x.language for x in got.timeline] == ["en", "de", "en"] and got.languages == ["de", "en"]
    lines = spark.createDataFrame([('{"type":"progress","track":1,"progress":0.5}',), ("Traceback",), ('{"x":1}',)], "value string")
    good, bad = records.event_lines(lines)
    assert good.first().progress == 0.5 and bad.count() == 2
    p = spark.createDataFrame([("out_time_us=5000000", 10.0), ("out_time_us=99000000", 10.0), ("frame=1", 10.0)], "l string, d double")
    assert [r[0] for r in p.select(records.encoder_progress(F.col("l"), F.col("d"))).collect()] == [0.5, 0.96, None]
    g = records.gpu_rows(spark.createDataFrame([("RTX, 16000, 200, 7",)], "value string")).first()
    assert (g.name, g.total_mb, g.load) == ("RTX", 16000.0, 7.0)


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", {}
    shape = "project string, track int, word string, start double, end double, language string, chunk int"
    src.mkdir()
    kept = []

    def append(rows, number):
        kept.append(rows.collect())

    def everything():
        return spark.createDataFrame([r for part in kept for r in part], shape)

    def replace(made):
        out.update({(r.track, r.cue): r.text for r in made.collect()})

    for words in ([("p", 0, " late", 5.0, 5.2, "en", 1)], [("p", 0, " early", 0.0, 0.2, "en", 0)]):
        spark.createDataFrame(words, shape).coalesce(1).write.mode("append").json(str(src))
        feeds.follow_words(spark.readStream.schema(shape).json(str(src)), append, everything, replace, str(tmp_path / "c")).awaitTermination()
    assert out == {(0, 0): "early", (0, 1): "late"}


def test_change_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 5, "z"), ("a", 1, "x"), ("b", 2, "y"), ("a", 3, "x")], "k string, n long, v string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    s = feeds.changes_stream(spark.readStream.schema("k string, n long, v string").json(str(tmp_path / "in")), "k", "n", "v")
    q = s.writeStream.format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n, r.v) for r in spark.table("changed").collect()) == [("a", 1, "x"), ("a", 5, "z"), ("b", 2, "y")]


def test_checks_hold_whatever_is_selected(spark):
    import pytest
    from cuelark.operators import store
    from cuelark.sources import subtitles

    cue = spark.createDataFrame([("c", "text", 1.0, 0.5)], "id string, text string, start double, end double")
    for columns in (["id"], ["end"], ["text"]):
        with pytest.raises(Exception, match="invalid cue c"):
            store.checked(cue).select(*columns).collect()
    bad = lambda t: spark.createDataFrame([("p", 0, "en", t)], "project string, track int, language string, text string")
    with pytest.raises(Exception, match="ends before it starts"):
        subtitles.read_srt(bad("1\n00:00:05,000 --> 00:00:01,000\nhello")).select("text").collect()
    with pytest.raises(Exception, match="unreadable subtitle timing"):
        subtitles.read_srt(bad("1\nsoon\nhello")).select("text").collect()


def test_first_free_names(spark):
    import pytest
    from cuelark.operators import tracks

    stems = spark.createDataFrame([("a",), ("b",), ("c-1",), ("d",)], "stem string")
    taken = spark.createDataFrame([("a",), ("a-2",), ("a-4",), ("c-1",), ("b-2",), ("d",), ("d-2",), ("d-2",), ("d-03",)], "name string")
    assert {r.stem: r.name for r in tracks.first_free_names(stems, taken).collect()} == {"a": "a-3", "b": "b", "c-1": "c-1-2", "d": "d-3"}
    with pytest.raises(Exception, match="no free name"):
        tracks.first_free_names(stems, taken, most=2).collect()


def test_segments(spark):
    s = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "track int, segment int")
    done = spark.createDataFrame([(1, 0, False), (2, 5, True)], "track int, segment int, complete boolean")
    assert [(r.track, r.segment) for r in feeds.new_segments(s, done).collect()] == [(1, 1)]


def test_seams(spark):
    w = spark.createDataFrame([("p", 0, 0, 10.0, [0.0] * 40_000), ("p", 0, 1, 20.0, [0.0] * 10)], "project string, track int, chunk int, start double, samples array<float>")
    got = seams.recognize(w, lambda: lambda x: [(" hi", 0.2, 0.4, 0.9, "en")]).orderBy("start").collect()
    assert [(r.word, r.start) for r in got] == [(" hi", 10.2), (" hi", 20.2)]
    lang = seams.detect_language(w, lambda: lambda x: ("en", 0.8)).orderBy("start").collect()
    assert [r.code for r in lang] == ["en", None]
    assert seams.filter_audio(w, lambda: lambda x: x * 0.5).count() == 2
    with pytest.raises(Exception, match="changed the length"):
        seams.filter_audio(w, lambda: lambda x: x[:5]).collect()
    assert len(w.select(seams.prepare_window(F.col("samples"), 100)).first()[0]) == 100


def test_translate(spark):
    cues = spark.createDataFrame([cue("a", "Hello", start=0.0, end=1.0), cue("b", "there.", start=1.1, end=2.0), cue("c", "Same", language="de", start=9.0, end=10.0)], CUE)
    none = spark.createDataFrame([], "cue_id string")
    got = {r.cue_id: (r.text, r.individually) for r in seams.translate(cues, none, "de", lambda: lambda s, t, x: " ".join(w.upper() for w in x.split())).collect()}
    assert got == {"a": ("HELLO", False), "b": ("THERE.", False), "c": ("Same", False)}
    short = {r.cue_id: (r.text, r.individually) for r in seams.translate(cues, none, "de", lambda: lambda s, t, x: "kurz").collect()}
    assert short["a"] == ("kurz", True)
    assert seams.translate(cues, spark.createDataFrame([("a",), ("b",), ("c",)], "cue_id string"), "de", lambda: lambda s, t, x: x).count() == 0



def test_overlay_and_mix(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None})], "x map<string,string>, y map<string,string>")
    assert df.select(tracks.overlay(F.col("x"), F.col("y"))).first()[0] == {"a": "1", "b": "3", "c": None}
    s = spark.createDataFrame([([0.5, -0.5, 0.5, -0.5], [1.0, -1.0])], "s array<double>, n array<double>")
    assert s.select(signal.mixed(F.col("s"), F.col("n"), F.lit(20.0))).first()[0] == pytest.approx([0.55, -0.55, 0.55, -0.55])


def test_a_request_meets_few_tracks_of_a_large_project(spark):
    """every request met every track of its project."""
    audio = spark.range(3000).select(F.lit(1).alias("project"), (F.col("id") % 2000).alias("stream_index"), F.col("id").alias("audio_ordinal"), F.when(F.col("id") > 5, F.col("id") % 3).alias("audio_language"))
    requests = spark.createDataFrame([(1, 1, 7, 8, 2), (2, 1, -1, 8, 2), (3, 1, -1, -1, 2), (4, 1, -1, -1, 9), (5, 1, None, None, None), (6, 2, 7, 8, 2)], "request int, project int, explicit int, source int, language int")
    made = tracks.preview_audio(requests, audio)
    assert made.columns == ["project", "request", "explicit", "source", "language", "stream_index", "audio_ordinal", "audio_language", "rank", "n"][:-1]
    assert {r.request: (r.stream_index, r.audio_ordinal, r["rank"]) for r in made.collect()} == {1: (7, 7, 0), 2: (8, 8, 1), 3: (8, 8, 2), 4: (0, 0, 3), 5: (0, 0, 3)}
    joins = made._jdf.queryExecution().optimizedPlan().toString()
    assert joins.count("Aggregate [") == 4


def test_members_of_an_utterance_take_one_fold(spark):
    """the fold ran once for the groups and again for the rows that they were joined to."""
    rows = [("p", 1, i * 2.0, i * 2.0 + 1, f"c{i}", f"text {i}", "en") for i in range(11)]
    made = tracks.signed(spark.createDataFrame(rows, "project string, track int, start double, end double, id string, text string, language string"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.id: [m.id for m in r.members] for r in made.collect()} == {f"c{i}": [f"c{j}" for j in (range(8) if i < 8 else range(8, 11))] for i in range(11)}
