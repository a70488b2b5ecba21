"""Subtitle and transcript texts as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clock, language_name, stable_id, strip, timestamp, unescape, without_markup, wrapped
from ..operators.sequence import blocks, in_order

TIMING = r"^\s*(\d+:\d{2}:\d{2}[,.]\d{3})\s+-->\s+(\d+:\d{2}:\d{2}[,.]\d{3})(?:\s+.*)?$"


def read_srt(files: DataFrame, codec: str = "subrip") -> DataFrame:
    """Cues of subtitle files (project, track, language, text).

    Blocks without words are dropped and keep their place in the numbering; a block without a
    readable timing line, or that ends before it starts, fails the job.
    """
    body = strip(F.regexp_replace(F.regexp_replace("text", "\r", ""), "^﻿", ""))
    block = files.select("project", "track", "language", F.posexplode(F.split(body, r"\n\s*\n")).alias("index", "block")).filter(F.length("block") > 0)
    lines = F.split("block", "\n")
    at = F.when(strip(F.get(lines, F.lit(0))).rlike(r"^\d+$"), 1).otherwise(0)
    parts = block.select("project", "track", "language", "index", F.get(lines, at).alias("timing"), F.array_join(F.slice(lines, at + 2, F.size(lines)), "\n").alias("styled_text"))
    good = F.coalesce(F.col("timing").rlike(TIMING), F.lit(False))
    start, end = (clock(F.regexp_extract("timing", TIMING, i)) for i in (1, 2))
    # checks are filters: no choice of columns later on removes them
    timed = parts.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("unreadable subtitle timing")).cast("boolean"))).select("project", "track", "language", "index", "styled_text", start.alias("start"), end.alias("end"))
    plain = timed.withColumn("text", strip(unescape(without_markup(F.col("styled_text"))))).filter(F.length("text") > 0)
    checked = F.when(F.col("end") > F.col("start"), F.lit(True)).otherwise(F.raise_error(F.lit("a subtitle ends before it starts")).cast("boolean"))
    return plain.filter(checked).select(
        stable_id(F.col("project"), F.col("track"), F.col("start"), F.col("index")).alias("id"), "project", "track", "start", "end", "text", F.col("text").alias("raw_text"), "styled_text", "language",
        F.array().cast("array<string>").alias("flags"), F.lit(False).alias("reviewed"), F.lit(False).alias("edited"), F.lit(f"Imported from embedded {codec.upper()} subtitles").alias("verification"), F.lit("embedded").alias("source_kind"),
    )


def read_srt_files(spark: SparkSession, path: str, project: str, track: int, language: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    return read_srt(whole.select(F.lit(project).alias("project"), F.lit(track).alias("track"), F.lit(language).alias("language"), "text"))


def srt_text(cues: DataFrame, translated: bool = False) -> DataFrame:
    """(project, track, text): subtitle files. With ``translated`` the text is ``translated_text``, and a missing one fails the job."""
    said = F.col("text")
    if translated:
        said = F.coalesce("translated_text", F.raise_error(F.lit("the translation is incomplete or stale")).cast("string"))
    rows = cues.withColumn("body", F.concat(timestamp(F.col("start")), F.lit(" --> "), timestamp(F.col("end")), F.lit("\n"), wrapped(said), F.lit("\n")))
    shown = F.array_sort(F.collect_list(F.struct("start", "end", "id", "body")))
    numbered = F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit("\n"), r["body"]))
    return rows.groupBy("project", "track").agg(shown.alias("rows")).select("project", "track", F.array_join(numbered, "\n").alias("text"))


def transcript_text(cues: DataFrame, view: str = "original", target: str = "en") -> DataFrame:
    """(project, track, text): whole transcripts; views: original, translated, parallel. A missing translation fails the job."""
    rows = blocks(cues)
    ready = F.coalesce("translation", F.raise_error(F.lit("the translation is incomplete or stale")).cast("string"))
    if view == "original":
        shown = F.col("text")
    elif view == "translated":
        shown = ready
    elif view == "parallel":
        shown = F.concat(F.lit("Original ("), language_name(F.col("language")), F.lit(")\n"), F.col("text"), F.lit("\n\n"), language_name(F.lit(target)), F.lit("\n"), ready)
    else:
        raise ValueError(f"no such view: {view}")
    return rows.groupBy("project", "track").agg(F.concat(in_order(["block"], shown, "\n\n"), F.lit("\n")).alias("text"))


def backup(projects: DataFrame, cues: DataFrame) -> DataFrame:
    """(project, body): a JSON document of each project and its cues in order."""
    each = cues.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("track", "start", "end", "id", "text", "language"))).alias("cues"))
    return projects.join(each, "project", "left").select("project", F.to_json(F.struct(F.struct(*projects.columns).alias("info"), F.coalesce("cues", F.array().cast(each.schema["cues"].dataType)).alias("cues"))).alias("body"))


def write_texts(rows: DataFrame, path: str) -> None:
    """One directory per project and track, whole texts inside; Spark's commit makes each appear at once."""
    rows.write.partitionBy("project", "track").mode("error").text(path)
