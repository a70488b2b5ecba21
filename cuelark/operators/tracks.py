"""Joins, choices and roll-ups over tracks, cues, translations and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TRANSLATION_VERSION, language_code, lookup, signature
from .ranges import running
from .sequence import utterances

# Subtitle codecs by kind, and (extension, muxer) of codecs that are kept as they are.
IMAGE_CODECS = ["hdmv_pgs_subtitle", "dvd_subtitle", "dvb_subtitle", "xsub", "arib_caption"]
TEXT_CODECS = ["subrip", "srt", "ass", "ssa", "webvtt", "mov_text", "text", "ttml", "dfxp", "microdvd", "mpl2", "jacosub", "sami", "realtext", "subviewer", "subviewer1", "vplayer", "pjs", "aqtitle", "eia_608", "hdmv_text_subtitle"]
NATIVE = {"subrip": "srt", "ass": "ass", "ssa": "ass", "webvtt": "vtt", "hdmv_pgs_subtitle": "sup", "ttml": "ttml"}

# ------------------------------------------------------------- rows and predicates


def of_track(cues: DataFrame, track: int | None = None) -> DataFrame:
    """Cues of one track, or of all without one."""
    return cues if track is None else cues.filter(F.col("track") == track)


def needs_review(flags: Column, reviewed: Column) -> Column:
    return (F.size(flags) > 0) & ~reviewed


def holds(text: Column, query: str) -> Column:
    return F.contains(F.lower(text), F.lit(query.lower()))


def valid_choice(asked: Column, there: Column) -> Column:
    """All asked for is there, and nothing is asked for twice."""
    return (F.size(F.array_except(asked, there)) == 0) & (F.size(F.array_distinct(asked)) == F.size(asked))


def word_doubts(probability, logprob, no_speech, compression, start, end, recovered) -> list[tuple]:
    """Doubts about a recognized word and their tests, in a fixed order, on columns or on arrays of numpy."""
    return [
        ("Low confidence", (probability < 0.5) | (logprob < -0.8)),
        ("Possible non-speech", no_speech > 0.5),
        ("Repetitive", compression > 2.4),
        ("Recovered", recovered),
        ("Unusual timing", (end <= start) | (end - start > 2)),
    ]


def word_flags(probability: Column, logprob: Column, no_speech: Column, compression: Column, start: Column, end: Column, recovered: Column | None = None) -> Column:
    """Doubts about a recognized word, in a fixed order."""
    rules = word_doubts(probability, logprob, no_speech, compression, start, end, recovered if recovered is not None else F.lit(False))
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules]), lambda x: x.isNotNull())


def edited(row: dict[str, str], new: dict[str, Column]) -> dict[str, Column]:
    """Partial update: given values replace, null ones don't; a new text or time marks the row as edited."""
    out = {name: F.coalesce(value, F.col(row[name])) for name, value in new.items()}
    touched = [new[n].isNotNull() for n in ("text", "start", "end") if n in new]
    if touched:
        mark = touched[0]
        for t in touched[1:]:
            mark = mark | t
        out["edited"] = F.col(row["edited"]) | mark
    return out


# ------------------------------------------------------------- joins


def with_translation(cues: DataFrame, translations: DataFrame) -> DataFrame:
    """Every cue, with its translation's text or null."""
    return cues.join(translations.select(F.col("cue_id").alias("id"), F.col("text").alias("translated_text")), "id", "left")


def group_signature(target: Column, digest: Column) -> Column:
    """Key over the cues of a group (``members``: id, text, language, track, start, end in order), the target and the model."""
    return signature(F.col("members"), target.alias("target"), F.lit(TRANSLATION_VERSION).alias("version"), digest.alias("digest"))


def signed(cues: DataFrame) -> DataFrame:
    """Cues with the ordered members of their utterance, at most eight: a window, so that the fold runs once."""
    member = F.struct("start", "end", "id", "text", "language", "track")
    group = ["project", "track", "utterance"]
    rows = utterances(cues).withColumn("members", F.array_sort(F.collect_list(member).over(Window.partitionBy(*group))))
    return rows.select(*group, *[c for c in rows.columns if c not in group])


def valid_translations(cues: DataFrame, saved: DataFrame, target: str) -> DataFrame:
    """Saved translations (cue_id, text, source_text, version, model_digest, source_signature) whose cue, group and rules haven't changed."""
    s = saved.filter(F.col("version") == TRANSLATION_VERSION).select("cue_id", F.col("text").alias("translated_text"), "source_text", "model_digest", "source_signature")
    rows = signed(cues).join(s, F.col("id") == F.col("cue_id"))
    same = (F.col("source_text") == F.col("text")) & (F.col("source_signature") == group_signature(F.lit(target), F.coalesce("model_digest", F.lit(""))))
    return rows.filter(same).select("project", "track", "utterance", "cue_id", "translated_text")


def tracks_with_cues(tracks: DataFrame, cues: DataFrame, on: str = "track") -> DataFrame:
    return tracks.join(cues, on, "left_semi")


def not_selected(tracks: DataFrame, selected: DataFrame, on: str = "track") -> DataFrame:
    return tracks.join(selected, on, "left_anti")


def overlaid(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows where old values, if any, stay on top."""
    before = old.select(key, *[F.col(c).alias(f"old_{c}") for c in columns])
    return new.join(before, key, "left").select(*[F.coalesce(f"old_{c}", c).alias(c) if c in columns else F.col(c) for c in new.columns])


def replaced_track(array: Column, stream_index: Column, track: Column) -> Column:
    """An array of track structs with the one of this stream index exchanged."""
    return F.transform(array, lambda t: F.when(t["stream_index"] == stream_index, track).otherwise(t))


def cue_source(cues: DataFrame, audio: DataFrame, subtitles: DataFrame) -> DataFrame:
    """Name of each cue's source: audio tracks have their stream index, subtitle tracks minus it minus one."""
    names = audio.select(F.col("stream_index").alias("track"), "name").unionByName(subtitles.select((-F.col("stream_index") - 1).alias("track"), "name"))
    return cues.join(names.withColumnRenamed("name", "source"), "track", "left")


def preview_audio(requests: DataFrame, audio: DataFrame) -> DataFrame:
    """One audio track per request (request, project, explicit, source, language): the explicit one, the same source, a language match, else the first.

    The first track of a project, of an index and of a language in it are chosen before the join, so
    that a request meets at most four tracks, however many its project has.
    """
    first = lambda *keys: audio.groupBy("project", *keys).agg(F.min_by(F.struct(*audio.columns), "audio_ordinal").alias("a"))
    found = requests.join(first().select("project", F.col("a").alias("a3")), "project")
    for n, (asked, has) in enumerate((("explicit", "stream_index"), ("source", "stream_index"), ("language", "audio_language"))):
        some = first(has).select(F.col("project").alias("_p"), F.col(has).alias("_has"), F.col("a").alias(f"a{n}"))
        found = found.join(some, (F.col("project") == F.col("_p")) & (F.col(asked) == F.col("_has")), "left").drop("_p", "_has")
    chosen = F.coalesce(*[F.when(F.col(f"a{n}").isNotNull(), F.struct(F.lit(n).alias("rank"), F.col(f"a{n}").alias("a"))) for n in range(4)])
    best = Window.partitionBy("request").orderBy("rank", "audio_ordinal")
    rows = found.select("project", *[c for c in requests.columns if c != "project"], chosen.alias("c")).select("*", *[F.col(f"c.a.{c}").alias(c) for c in audio.columns if c != "project"], "c.rank").drop("c")
    return rows.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")


# ------------------------------------------------------------- aggregates


def best_language(primary: DataFrame, second: DataFrame, least: float = 0.7) -> DataFrame:
    """Highest score per track and language; the second source counts from ``least``."""
    return primary.unionByName(second.filter(F.col("score") >= least)).groupBy("track", "language").agg(F.max("score").alias("score"))


def single_language(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The one language of a group, und if there are several."""
    return rows.groupBy(*keys).agg(F.when(F.countDistinct("language") == 1, F.min("language")).otherwise(F.lit("und")).alias("language"))


def review_counts(cues: DataFrame, keys: list[str]) -> DataFrame:
    return cues.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cues"), F.count_if(F.col("translated_text").isNotNull()).alias("translated"),
        F.count_if(needs_review(F.col("flags"), F.col("reviewed"))).alias("review"), F.count_if(F.size("flags") > 0).alias("flagged"), F.count_if("edited").alias("edited"),
    )


def complete_tracks(cues: DataFrame, translations: DataFrame, keys: list[str]) -> DataFrame:
    return with_translation(cues, translations).groupBy(*keys).agg(F.every(F.col("translated_text").isNotNull()).alias("complete"))


def projects_with_counts(projects: DataFrame, jobs: DataFrame, cues: DataFrame) -> DataFrame:
    """Projects beside their numbers of jobs and cues: each is counted before it is joined."""
    a = jobs.groupBy("project").agg(F.count(F.lit(1)).alias("jobs"))
    b = cues.groupBy("project").agg(F.count(F.lit(1)).alias("cues"))
    return projects.join(a, "project", "left").join(b, "project", "left").fillna(0, ["jobs", "cues"])


# ------------------------------------------------------------- subtitle streams and remuxing


def describe_subtitles(streams: DataFrame) -> DataFrame:
    """Subtitle streams (project, stream_index, codec, tag_language, title, dispositions map) as tracks."""
    codec = F.col("codec")
    kind = F.when(codec.isin(IMAGE_CODECS), "image").when(codec.isin(TEXT_CODECS), "text").otherwise("unknown")
    ordinal = F.row_number().over(Window.partitionBy("project").orderBy("stream_index")) - 1
    return streams.select(
        "project", "stream_index", ordinal.alias("subtitle_ordinal"), (-F.col("stream_index") - 1).alias("cue_track"), "codec", kind.alias("kind"), F.coalesce("title", F.lit("")).alias("title"),
        language_code(F.col("tag_language")).alias("language"), F.coalesce(lookup(NATIVE, codec), F.when(kind == "text", "srt").otherwise("mks")).alias("extract_extension"),
        F.array_sort(F.map_keys(F.map_filter("dispositions", lambda _, v: v != 0))).alias("dispositions"),
    )


def extraction_plan(tracks: DataFrame, normalized: bool = False) -> DataFrame:
    """Extension and codec of each extracted file: as it is, or text as SRT when ``normalized``; an image track can't be text."""
    srt = F.lit(normalized) & (F.col("kind") == "text")
    return tracks.withColumn("extension", F.when(srt, "srt").otherwise(F.col("extract_extension"))).withColumn("encoder", F.when(srt & (F.col("codec") != "subrip"), "srt").otherwise("copy")).filter(~F.lit(normalized) | (F.col("kind") == "text"))


def subtitle_choices(embedded: DataFrame, audio: DataFrame, translations: DataFrame) -> DataFrame:
    """What can be embedded: embedded tracks, audio tracks with cues, complete translations. Columns: track, language, kind."""
    out = embedded.withColumn("kind", F.lit("embedded"))
    return out.unionByName(audio.withColumn("kind", F.lit("transcript"))).unionByName(translations.withColumn("kind", F.lit("translation")))


def remux_entries(embedded: DataFrame, selections: DataFrame) -> DataFrame:
    """Kept embedded tracks (those not replaced) and the selections; a kept track loses its default mark if a selection has one."""
    kept = embedded.join(selections.filter("replaces is not null").select(F.col("replaces").alias("track")), "track", "left_anti")
    claims = F.broadcast(selections.agg(F.coalesce(F.bool_or("is_default"), F.lit(False)).alias("claimed")))  # one row
    kept = kept.join(claims).select("track", "language", (F.col("is_default") & ~F.col("claimed")).alias("is_default"), F.lit("kept").alias("origin"))
    return kept.unionByName(selections.select("track", "language", "is_default", F.lit("selected").alias("origin")))


def first_free_names(stems: DataFrame, taken: DataFrame, most: int = 10_000) -> DataFrame:
    """(stem, name): stem, stem-2, stem-3, ...: the first that no row (name) of ``taken`` has; none up to ``most`` fails the job.

    The numbers taken of a stem are counted up to the first gap; no range of candidates is expanded.
    """
    number = F.coalesce(F.regexp_extract("name", r"^.*-([1-9][0-9]{0,8})$", 1).try_cast("int"), F.lit(0))
    numbered = taken.select(F.regexp_replace("name", r"-[1-9][0-9]{0,8}$", "").alias("stem"), number.alias("n")).filter("n > 1")
    used = numbered.unionByName(taken.select(F.col("name").alias("stem"), F.lit(1).alias("n"))).distinct()
    run = used.withColumn("place", F.row_number().over(Window.partitionBy("stem").orderBy("n"))).filter("n = place").groupBy("stem").agg(F.max("n").alias("last"))
    free = F.coalesce("last", F.lit(0)) + 1
    name = F.when(free == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), free.cast("string")))
    return stems.select("stem").distinct().join(run, "stem", "left").filter(F.when(free <= most, F.lit(True)).otherwise(F.raise_error(F.lit("no free name")).cast("boolean"))).select("stem", name.alias("name"))


def field_is(body: Column, path: str, value: str) -> Column:
    """Rows whose JSON body holds this value under a path like ``$.a.b``; a missing field is no match."""
    return F.coalesce(F.get_json_object(body, path) == value, F.lit(False))


def by_score(values: Column, score) -> Column:
    """An array ordered by descending score; equal scores keep their order."""
    marked = F.transform(values, lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(marked), lambda r: r["x"])


# ------------------------------------------------------------- orders and pages


def newest_per_key(rows: DataFrame, keys: list[str], newest: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(newest), tie)
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows with the number of all rows beside each; the count is its own aggregate, not a window over everything."""
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # one row
    return rows.orderBy(*order).offset(offset).limit(limit).join(total)


def evictions(files: DataFrame, most: float, keep: Column) -> DataFrame:
    """Files to delete, newest first, once the sizes so far pass ``most``; never the kept one. A pool of any size spreads over tasks."""
    sized = running(files, ["pool"], [F.desc("modified"), F.col("path")], {"so_far": F.col("size")})
    return sized.filter((F.col("so_far") > most) & ~keep)


# ------------------------------------------------------------- settings and messages


def overlay(*maps: Column) -> Column:
    """Maps put over each other; later keys win, whatever the session says about repeated keys."""
    keys = F.array_distinct(F.flatten(F.array(*[F.map_keys(m) for m in maps])))

    def value(key: Column) -> Column:
        out = F.element_at(maps[0], key)
        for m in maps[1:]:
            out = F.when(F.array_contains(F.map_keys(m), key), F.element_at(m, key)).otherwise(out)
        return out

    return F.map_from_arrays(keys, F.transform(keys, value))


def settings(given: Column, defaults: dict[str, str]) -> Column:
    """Job settings over defaults; the retired ``audio_profile`` becomes ``enhance`` (anything but original) unless that is given."""
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    old = F.element_at(given, F.lit("audio_profile"))
    moved = F.when(old.isNotNull(), F.create_map(F.lit("enhance"), (old != "original").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_filter(overlay(base, moved, F.map_filter(given, lambda _, v: v.isNotNull())), lambda k, _: k != "audio_profile")


def messages(*lists: Column) -> Column:
    """All messages of several lists, each once, in order of first appearance."""
    return F.array_distinct(F.flatten(F.array(*lists)))


def hint_flag(flags: Column, language: Column, hint: Column, score: Column) -> Column:
    """Marks words whose chunk was heard as another language with some confidence."""
    return F.when((score > 0.75) & (hint != language), F.array_append(flags, F.lit("Language differs"))).otherwise(flags)
