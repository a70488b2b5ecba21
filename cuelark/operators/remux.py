"""Plans for embedding subtitles: one row a project, either a plan or the first rule it breaks.

Requests, selections, streams, cues and translations are tables over all projects. Each rule is a
column over what groups and joins by project and track bring together; no project is looped over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_tag
from .media import output_allowed

# Subtitle codecs that Matroska takes as they are, and the languages' name for the words as spoken.
MATROSKA = ["subrip", "ass", "ssa", "webvtt", "hdmv_pgs_subtitle", "dvd_subtitle", "dvb_subtitle"]
ORIGINAL = "original"

#: Refusals, in the order in which they are looked for; those of a selection come in the selections' order.
REFUSALS = {
    "changed": "the source file has changed since it was read",
    "target": "the target must be an absolute .mkv or .mp4 path",
    "same": "the target is the source itself",
    "exists": "the target exists already",
    "video": "there is no video to embed into",
    "none": "nothing is selected",
    "twice": "a subtitle version is selected twice",
    "defaults": "more than one selection is the default",
    "source": "a selected source doesn't exist",
    "cues": "a selected source has no cues yet",
    "stale": "a selected translation is missing or out of date",
    "data": "Matroska can't hold the data stream",
    "image": "MP4 can't hold image subtitles",
    "attachment": "MP4 can't hold attachments",
}
WARNINGS = {
    "timed": "MP4 turns subtitles into timed text and loses their styles",
    "converted": "text formats that Matroska doesn't know become SRT",
    "plain": "translated or edited subtitles have SRT styles only",
}
ENTRY = "struct<position:int,track:bigint,stream_index:bigint,embedded:boolean,native:boolean,kind:string,codec:string,language:string,title:string,is_default:boolean,forced:boolean,dispositions:array<string>>"


def sources(audio: DataFrame, subtitles: DataFrame) -> DataFrame:
    """Whatever cues can come from: (project, track, stream_index, embedded, kind, codec, source_language, title, label, forced, dispositions).

    Audio (project, stream_index, audio_ordinal, title) has its stream index as track; subtitles
    are what :func:`tracks.describe_subtitles` returns.
    """
    label = lambda title, name, ordinal: F.when(F.length(title) > 0, title).otherwise(F.concat(F.lit(name), (ordinal + 1).cast("string")))
    nothing, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    a = audio.select(
        "project", F.col("stream_index").cast("long").alias("track"), F.col("stream_index").cast("long").alias("stream_index"), F.lit(False).alias("embedded"), nothing.alias("kind"), nothing.alias("codec"),
        nothing.alias("source_language"), "title", label(F.col("title"), "Audio ", F.col("audio_ordinal")).alias("label"), F.lit(False).alias("forced"), none.alias("dispositions"),
    )
    s = subtitles.select(
        "project", F.col("cue_track").cast("long").alias("track"), F.col("stream_index").cast("long").alias("stream_index"), F.lit(True).alias("embedded"), "kind", "codec",
        F.col("language").alias("source_language"), "title", label(F.col("title"), "Embedded subtitles ", F.col("subtitle_ordinal")).alias("label"), F.array_contains("dispositions", "forced").alias("forced"), "dispositions",
    )
    return a.unionByName(s)


def choices(every: DataFrame, cues: DataFrame, complete: DataFrame) -> DataFrame:
    """(project, track, language, label, kind, native) of all that can be embedded, from stored tables.

    Embedded tracks as they are, audio tracks that have cues, and the languages in which all cues
    of a track are validly translated. ``cues`` are (project, track, language, edited), ``complete``
    (project, track, language), one row each.
    """
    have = cues.groupBy("project", "track").agg(F.bool_or("edited").alias("edited"))
    known = every.join(have.withColumn("has", F.lit(True)), ["project", "track"], "left")
    own = known.filter(F.col("embedded") | F.col("has")).select("project", "track", F.lit(ORIGINAL).alias("language"), "label", F.when(F.col("embedded"), F.col("kind")).otherwise("text").alias("kind"), (F.col("embedded") & ~F.coalesce("edited", F.lit(False))).alias("native"))
    told = complete.join(known.filter("has").select("project", "track", "label"), ["project", "track"]).select("project", "track", "language", "label", F.lit("text").alias("kind"), F.lit(False).alias("native"))
    return own.unionByName(told)


def complete_translations(cues: DataFrame, valid: DataFrame) -> DataFrame:
    """(project, track, language) in which every cue of the track has a valid translation (project, cue_id, language)."""
    languages = valid.select("project", "cue_id", "language").distinct()
    told = cues.select("project", "track", F.col("id").alias("cue_id")).join(languages, ["project", "cue_id"]).groupBy("project", "track", "language").agg(F.count(F.lit(1)).alias("told"))
    return told.join(cues.groupBy("project", "track").agg(F.count(F.lit(1)).alias("cues")), ["project", "track"]).filter("told = cues").select("project", "track", "language")


def _first(rules: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules], F.lit(None).cast("string"))


def plans(requests: DataFrame, selections: DataFrame, every: DataFrame, auxiliary: DataFrame, cues: DataFrame, complete: DataFrame) -> DataFrame:
    """(project, source, target, refusal, entries, warnings, chapters): one row a request, with ``refusal`` null or the name of the first rule broken.

    * requests: project, source, target, changed, exists, has_video, keep_embedded
    * selections: project, position, track, language (``original`` or a target), is_default
    * every: see :func:`sources`; auxiliary: project, stream_index, type, chapter
    * cues: project, track, language, edited; complete: see :func:`complete_translations`

    Embedded tracks that no selection of their original replaces stay in front when asked for; they
    lose their default mark to a selection that claims it. An embedded track whose cues nobody
    edited is copied as it is, anything else becomes SRT. A refused project has no entries.
    """
    by = ["project", "track"]
    stats = cues.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bool_or("edited").alias("edited"), F.when(F.count_distinct("language") == 1, F.min("language")).otherwise("und").alias("spoken"))
    done = complete.select("project", "track", "language").distinct().withColumn("told", F.lit(True))
    chosen = selections.withColumn("track", F.col("track").cast("long")).join(every, by, "left").join(stats, by, "left").join(done, [*by, "language"], "left")
    asked = F.col("language") == ORIGINAL
    native = F.coalesce(F.col("embedded") & asked & ~F.coalesce("edited", F.lit(False)), F.lit(False))
    wrong = _first([("source", F.col("embedded").isNull()), ("cues", ~native & F.col("n").isNull()), ("stale", ~native & ~asked & F.col("told").isNull())])
    tongue = F.when(native, F.col("source_language")).when(asked, F.col("spoken")).otherwise(F.col("language"))
    entry = lambda position, is_native, language, title, default: F.struct(
        position.cast("int").alias("position"), "track", "stream_index", "embedded", is_native.alias("native"), "kind", "codec", language.alias("language"), title.alias("title"), default.alias("is_default"), "forced", "dispositions"
    )
    title = F.when(native, F.coalesce("title", F.lit(""))).otherwise(F.concat(F.upper(tongue), F.lit(" · "), F.col("label")))
    picked = chosen.groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct(F.col("position").cast("int").alias("position"), wrong.alias("wrong"), entry(F.col("position"), native, tongue, title, F.coalesce("is_default", F.lit(False))).alias("entry")))).alias("picked"),
        F.count(F.lit(1)).alias("asked"), F.count_distinct("track", "language").alias("different"), F.count_if(F.coalesce("is_default", F.lit(False))).alias("defaults"),
    )
    replaced = selections.filter(F.col("language") == ORIGINAL).select("project", F.col("track").cast("long").alias("track")).distinct()
    stays = every.filter("embedded").join(replaced, by, "left_anti")
    kept = stays.groupBy("project").agg(F.array_sort(F.collect_list(entry(F.col("stream_index"), F.lit(True), F.col("source_language"), F.coalesce("title", F.lit("")), F.array_contains("dispositions", "default")))).alias("kept"))
    beside = auxiliary.groupBy("project").agg(
        F.bool_or((F.col("type") == "data") & ~F.col("chapter")).alias("data"), F.bool_or(F.col("type") == "attachment").alias("attachment"), F.array_sort(F.collect_list(F.when(F.col("chapter"), F.col("stream_index")))).alias("chapters")
    )
    rows = requests.join(picked, "project", "left").join(kept, "project", "left").join(beside, "project", "left")
    none = F.array().cast(f"array<{ENTRY}>")
    front = F.when(F.col("keep_embedded"), F.coalesce("kept", none)).otherwise(none)
    front = F.when(F.col("defaults") > 0, F.transform(front, lambda e: e.withField("is_default", F.lit(False)))).otherwise(front)
    rows = rows.withColumn("entries", F.concat(front, F.coalesce(F.transform("picked", lambda p: p["entry"]), none)))
    mp4 = F.lower("target").endswith(".mp4")
    is_text = lambda e: e["native"] & (F.coalesce(e["kind"], F.lit("")) == "text")
    not_text = lambda e: e["native"] & (F.coalesce(e["kind"], F.lit("")) != "text")
    refusal = F.coalesce(
        _first([
            ("changed", F.col("changed")), ("target", ~output_allowed(F.col("target"), F.lit(""), [".mkv", ".mp4"])), ("same", F.col("target") == F.col("source")), ("exists", F.col("exists")), ("video", ~F.col("has_video")),
            ("none", F.col("asked").isNull()), ("twice", F.col("different") < F.col("asked")), ("defaults", F.col("defaults") > 1),
        ]),
        F.get(F.filter(F.transform("picked", lambda p: p["wrong"]), lambda w: w.isNotNull()), F.lit(0)),
        _first([("data", ~mp4 & F.col("data")), ("image", mp4 & F.exists("entries", not_text)), ("attachment", mp4 & F.col("attachment"))]),
    )
    warnings = [
        ("timed", mp4),
        ("converted", ~mp4 & F.exists("entries", lambda e: is_text(e) & ~e["codec"].isin(MATROSKA))),
        ("plain", F.exists("entries", lambda e: ~e["native"] & e["embedded"])),
    ]
    warned = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in warnings]), lambda w: w.isNotNull())
    rows = rows.withColumn("refusal", refusal).withColumn("warnings", warned)
    good = F.col("refusal").isNull()
    return rows.select("project", "source", "target", "refusal", F.when(good, F.col("entries")).otherwise(none).alias("entries"), F.when(good, F.col("warnings")).otherwise(F.array().cast("array<string>")).alias("warnings"), F.coalesce("chapters", F.array().cast("array<bigint>")).alias("chapters"))


def messages(names: Column, texts: dict[str, str]) -> Column:
    """Names of refusals or warnings as sentences."""
    table = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return F.transform(names, lambda n: F.element_at(table, n))


def arguments(source: Column, target: Column, entries: Column, chapters: Column, folder: str) -> Column:
    """Command words of a plan: every stream of the source but its subtitles and chapter streams, then the entries in order.

    The texts of entries that aren't native lie in ``folder`` as subtitle-N.srt, N being their place
    among the entries. MP4 takes timed text only; text formats that Matroska doesn't know become SRT.
    """
    words = lambda *parts: F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    text = lambda n: n.cast("string")
    mp4 = F.lower(target).endswith(".mp4")
    numbered = F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    made = F.filter(numbered, lambda x: ~x["e"]["native"])
    inputs = F.flatten(F.transform(made, lambda x: words("-i", F.concat(F.lit(f"{folder}/subtitle-"), text(x["i"]), F.lit(".srt")))))

    def one(x: Column) -> Column:
        e, i = x["e"], text(x["i"])
        number = F.size(F.filter(made, lambda m: m["i"] <= x["i"]))
        origin = F.when(e["native"], F.concat(F.lit("0:"), text(e["stream_index"]))).otherwise(F.concat(text(number), F.lit(":s:0")))
        foreign = e["native"] & (F.coalesce(e["kind"], F.lit("")) == "text") & ~e["codec"].isin(MATROSKA)
        codec = F.when(mp4, "mov_text").when(foreign, "srt").otherwise("copy")
        marks = F.concat(F.filter(e["dispositions"], lambda d: ~d.isin("default", "forced")), F.when(e["is_default"], F.array(F.lit("default"))).otherwise(F.array().cast("array<string>")), F.when(e["forced"], F.array(F.lit("forced"))).otherwise(F.array().cast("array<string>")))
        marked = F.when(F.size(marks) > 0, F.array_join(marks, "+")).otherwise("0")
        stream = lambda name: F.concat(F.lit(name), i)
        return words("-map", origin, stream("-c:s:"), codec, stream("-metadata:s:s:"), F.concat(F.lit("language="), language_tag(e["language"])), stream("-metadata:s:s:"), F.concat(F.lit("title="), e["title"]), stream("-disposition:s:"), marked)

    without = F.flatten(F.transform(chapters, lambda c: words("-map", F.concat(F.lit("-0:"), text(c)))))
    fixed = words("-map_metadata", "0", "-map_chapters", "0", "-c", "copy")
    end = F.when(mp4, words("-movflags", "+faststart", "-f", "mp4")).otherwise(words("-f", "matroska"))
    start = words("-nostdin", "-v", "error", "-n", "-copyts", "-start_at_zero", "-i", source)
    return F.concat(start, inputs, words("-map", "0", "-map", "-0:s?"), without, fixed, F.flatten(F.transform(numbered, one)), words("-avoid_negative_ts", "disabled"), end, words(target))
