"""Word, cue and translation inputs made from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tracks import group_signature, signed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a Python worker holds a batch at a time: bounded by bytes, it needs no more room for long texts or larger tables
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_start(pos: Column) -> Column:
    """Seconds; a word ends .3 s later."""
    return pos * 0.35 + F.floor(pos / 37) * 1.0


def _timed(rows: DataFrame) -> DataFrame:
    start = word_start(F.col("pos"))
    return rows.select(F.lit("p").alias("project"), F.col("track").cast("int").alias("track"), "pos", F.concat(F.lit(" "), "word").alias("word"), start.alias("start"), (start + 0.3).alias("end"), "language", F.floor(F.col("pos") / 50).cast("int").alias("chunk"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents, one every .35 s with a pause after each 37."""
    d = table(spark, sf_dir, "documents")
    parts = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return _timed(d.select(F.col("doc_id").alias("track"), F.col("lang").alias("language"), F.posexplode(parts).alias("pos", "word")))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, n): how many words each document with words has. Their places are 0 to n - 1. No text is split for that."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("track"), "text").mapInArrow(_counted, "track int, n int").filter("n > 0")


def _counted(batches):
    space = np.zeros(256, bool)
    space[list(b" \t\n\x0b\f\r")] = True
    for b in batches:
        text = b.column("text").cast(pa.binary())
        ends = np.frombuffer(text.buffers()[1], "int32")[text.offset : text.offset + len(text) + 1]
        quiet = space[np.frombuffer(text.buffers()[2] or b"", "uint8")[ends[0] : ends[-1]]]
        # a word begins behind white space and where a text begins
        begins = np.append(~quiet, False)
        begins[1:-1] &= quiet[:-1]
        first = ends[:-1][np.diff(ends) > 0] - ends[0]
        begins[first] = ~quiet[first]
        sums = np.append(0, np.cumsum(begins))
        yield pa.RecordBatch.from_arrays([b.column("track"), pa.array(np.diff(sums[ends - ends[0]]), pa.int32())], ["track", "n"])


def words_at_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, track, _n): a text of n characters has at most (n + 1) / 2 words. No text is split for that."""
    n = F.coalesce(F.floor((F.length("text") + 1) / 2), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.lit("p").alias("project"), F.col("doc_id").cast("int").alias("track"), n.alias("_n"))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations in order of turns; the language is the role, so it changes within a track."""
    c = table(spark, sf_dir, "conversations")
    parts = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return c.select(F.col("conv_id").cast("int").alias("track"), "turn", F.col("role").alias("language"), F.posexplode(parts).alias("i", "word")).select(
        F.lit("p").alias("project"), "track", F.concat(F.lit(" "), "word").alias("word"), (F.col("turn") * 1000.0 + F.col("i") * 0.35).alias("start"), (F.col("turn") * 1000.0 + F.col("i") * 0.35 + 0.3).alias("end"), "language", F.lit(0).alias("chunk")
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 4.0
    fast = F.length("text") / 3 > 200
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("p").alias("project"), F.col("conv_id").cast("int").alias("track"), "turn", start.alias("start"), (start + 3).alias("end"),
        "text", F.col("text").alias("raw_text"), F.col("role").alias("language"), F.when(fast, F.array(F.lit("Fast speech"))).otherwise(F.array().cast("array<string>")).alias("flags"), (F.col("conv_id") % 2 == 0).alias("reviewed"), (F.col("turn") % 3 == 0).alias("edited"),
    )


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved translations of cues: texts changed since where track % 7 = 0, none where % 11 = 0, old rules where % 13 = 0."""
    c = signed(cues(spark, sf_dir)).filter("track % 11 <> 0")
    return c.select(
        F.col("id").alias("cue_id"), F.lit("p").alias("project"), F.lit("en").alias("language"), F.concat(F.lit("T "), F.substr("text", F.lit(1), F.lit(20))).alias("text"),
        F.when(F.col("track") % 7 == 0, F.lit("old")).otherwise(F.col("text")).alias("source_text"), F.when(F.col("track") % 13 == 0, 1).otherwise(2).alias("version"), F.lit("m1").alias("model_digest"),
        group_signature(F.lit("en"), F.lit("m1")).alias("source_signature"),
    )


# The same in SQL, as common table expressions.
WORDS = """words as (
  select track, language, pos, ' ' || word as word, pos * 0.35::double + (pos // 37) * 1.0::double as start, pos * 0.35::double + (pos // 37) * 1.0::double + 0.3::double as stop
  from (select doc_id as track, lang as language, unnest(parts) as word, generate_subscripts(parts, 1) - 1 as pos
        from (select doc_id, lang, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as parts from documents)))"""
SPOKEN = """spoken as (
  select track, language, ' ' || word as word, turn * 1000.0::double + i * 0.35::double as start, turn * 1000.0::double + i * 0.35::double + 0.3::double as stop
  from (select conv_id as track, turn, role as language, unnest(parts) as word, generate_subscripts(parts, 1) - 1 as i
        from (select conv_id, turn, role, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as parts from conversations)))"""
CUES = """cues as (
  select conv_id || '-' || turn as id, conv_id as track, turn, turn * 4.0::double as start, turn * 4.0::double + 3 as stop, text, role as language,
         length(text) / 3.0 > 200 as fast, conv_id % 2 = 0 as reviewed, turn % 3 = 0 as edited
  from conversations)"""
TRANSLATIONS = """saved as (select id as cue_id, 'T ' || substr(text, 1, 20) as translated_text, track from cues where track % 11 <> 0)"""
