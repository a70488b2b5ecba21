"""Remux plans: every refusal and warning, entries, choices and command words."""

import pytest
from pyspark.sql import functions as F

from cuelark.operators import remux, tracks

REQUEST = "project string, source string, target string, changed boolean, exists boolean, has_video boolean, keep_embedded boolean"
STREAM = "project string, stream_index int, codec string, tag_language string, title string, dispositions map<string,int>"
CUE = "project string, track long, id string, language string, edited boolean"


def tables(spark, requests, selections, streams=(), audio=(), auxiliary=(), cues=(), complete=()):
    made = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    every = remux.sources(made(audio, "project string, stream_index int, audio_ordinal int, title string"), tracks.describe_subtitles(made(streams, STREAM)))
    return (
        made(requests, REQUEST), made(selections, "project string, position int, track long, language string, is_default boolean"), every,
        made(auxiliary, "project string, stream_index long, type string, chapter boolean"), made(cues, CUE), made(complete, "project string, track long, language string"),
    )


def test_each_refusal(spark):
    """One project a rule, all else right; with two rules broken the first one counts."""
    good = {"source": "/in/a.mkv", "target": "/out/a.mkv", "changed": False, "exists": False, "has_video": True, "keep_embedded": True}
    one = [(0, 1, "original", False)]
    case = {
        "changed": ({"changed": True, "has_video": False}, one), "target": ({"target": "out.mkv"}, one), "same": ({"target": "/in/a.mkv"}, one), "exists": ({"exists": True}, one), "video": ({"has_video": False}, one),
        "none": ({}, []), "twice": ({}, [(0, 1, "original", False), (1, 1, "original", False)]), "defaults": ({}, [(0, 1, "original", True), (1, -4, "original", True)]), "source": ({}, [(0, 1, "original", False), (1, 50, "original", False), (2, 1, "xx", False)]),
        "cues": ({}, [(0, 2, "original", False), (1, 50, "original", False)]), "stale": ({}, [(0, 1, "fr", False)]), "data": ({}, one), "image": ({"target": "/out/a.mp4"}, one), "attachment": ({"target": "/out/a.MP4"}, one), "fine": ({}, one),
    }
    requests = [(name, *(good | change).values()) for name, (change, _) in case.items()]
    selections = [(name, *s) for name, (_, chosen) in case.items() for s in chosen]
    streams = [(name, 3, "subrip", "eng", None, {"default": 0}) for name in case] + [("image", 4, "hdmv_pgs_subtitle", "eng", None, {"default": 1})]
    audio = [(name, i, i - 1, "") for name in case for i in (1, 2)]
    auxiliary = [("data", 9, "data", False), ("fine", 9, "data", True), ("attachment", 9, "attachment", False), ("fine", 8, "attachment", False)]
    cues = [(name, 1, f"{name}-{i}", "en", False) for name in case for i in range(2)]
    rows = {r.project: r for r in remux.plans(*tables(spark, requests, selections, streams, audio, auxiliary, cues)).collect()}
    assert {name: r.refusal for name, r in rows.items()} == {name: None if name == "fine" else name for name in case} and set(case) == {*remux.REFUSALS, "fine"}
    assert all(not r.entries and not r.warnings for r in rows.values() if r.refusal) and len(rows["fine"].entries) == 2 and rows["fine"].chapters == [9]


def test_entries_and_arguments(spark):
    streams = [("p", 3, "subrip", "eng", "Full", {"default": 1, "forced": 0}), ("p", 4, "mov_text", "ger", None, {"default": 0, "forced": 1, "comment": 1}), ("p", 5, "ass", "fra", None, {"default": 0})]
    chosen = [("p", 0, 1, "original", True), ("p", 1, -5, "original", False), ("p", 2, -6, "original", False), ("p", 3, 1, "de", False)]
    cues = [("p", 1, "a", "en", False), ("p", 1, "b", "fr", False), ("p", -6, "c", "fr", True)]
    inputs = lambda target: tables(spark, [("p", "/in/x.mkv", target, False, False, True, True)], chosen, streams, [("p", 1, 0, "Main")], [("p", 7, "data", True)], cues, [("p", 1, "de")])
    plan = remux.plans(*inputs("/out/x.mkv"))
    row = plan.first()
    shown = [(e.track, e.native, e.language, e.title, e.is_default, e.forced) for e in row.entries]
    assert shown == [(-4, True, "en", "Full", False, False), (1, False, "und", "UND · Main", True, False), (-5, True, "de", "", False, True), (-6, False, "fr", "FR · Embedded subtitles 3", False, False), (1, False, "de", "DE · Main", False, False)]
    assert row.warnings == ["converted", "plain"] and plan.select(remux.messages("warnings", remux.WARNINGS)).first()[0] == [remux.WARNINGS["converted"], remux.WARNINGS["plain"]]
    words = plan.select(remux.arguments(F.col("source"), F.col("target"), F.col("entries"), F.col("chapters"), "/tmp/work")).first()[0]
    text = " ".join(words)
    assert text.startswith("-nostdin -v error -n -copyts -start_at_zero -i /in/x.mkv -i /tmp/work/subtitle-1.srt -i /tmp/work/subtitle-3.srt -i /tmp/work/subtitle-4.srt -map 0 -map -0:s? -map -0:7 -map_metadata 0 -map_chapters 0 -c copy")
    assert "-map 0:3 -c:s:0 copy -metadata:s:s:0 language=eng -metadata:s:s:0 title=Full -disposition:s:0 0" in text and "-map 0:4 -c:s:2 srt" in text and "-disposition:s:2 comment+forced" in text
    assert "-map 1:s:0 -c:s:1 copy" in text and "-disposition:s:1 default" in text and "-map 3:s:0 -c:s:4 copy" in text and text.endswith("-f matroska /out/x.mkv")
    mp4 = remux.plans(*inputs("/out/x.mp4"))
    assert mp4.first().warnings == ["timed", "plain"]
    words = mp4.select(remux.arguments(F.col("source"), F.col("target"), F.col("entries"), F.col("chapters"), "/w")).first()[0]
    assert words.count("mov_text") == 5 and words[-5:] == ["-movflags", "+faststart", "-f", "mp4", "/out/x.mp4"]


def test_choices_come_from_stored_tables(spark):
    *_, every, _, cues, _ = tables(
        spark, [], [], [("p", 3, "subrip", "eng", "Full", {"default": 1}), ("p", 4, "dvd_subtitle", "eng", None, {"default": 1})], [("p", 1, 0, ""), ("p", 2, 1, "Two")],
        cues=[("p", 1, "a", "en", False), ("p", 1, "b", "en", False), ("p", -4, "c", "en", True), ("q", 1, "a", "en", False)],
    )
    valid = spark.createDataFrame([("p", "a", "de"), ("p", "b", "de"), ("p", "b", "de"), ("p", "a", "fr"), ("p", "c", "fr"), ("q", "b", "de")], "project string, cue_id string, language string")
    complete = remux.complete_translations(cues, valid)
    assert {tuple(r) for r in complete.collect()} == {("p", 1, "de"), ("p", -4, "fr")}
    got = {(r.track, r.language): (r.label, r.kind, r.native) for r in remux.choices(every, cues, complete).collect()}
    assert got == {(1, "original"): ("Audio 1", "text", False), (-4, "original"): ("Full", "text", False), (-5, "original"): ("Embedded subtitles 2", "image", True), (1, "de"): ("Audio 1", "text", False), (-4, "fr"): ("Full", "text", False)}


def test_remux_of_nothing(spark):
    assert remux.plans(*tables(spark, [], [])).collect() == []


@pytest.mark.parametrize("keep", [True, False])
def test_embedded_tracks_are_kept_when_asked(spark, keep):
    rows = tables(spark, [("p", "/a.mkv", "/b.mkv", False, False, True, keep)], [("p", 0, 1, "original", False)], [("p", 3, "subrip", "eng", None, {"default": 1})], [("p", 1, 0, "")], cues=[("p", 1, "a", "en", False)])
    assert [(e.track, e.is_default) for e in remux.plans(*rows).first().entries] == [(-4, True)] * keep + [(1, False)]
