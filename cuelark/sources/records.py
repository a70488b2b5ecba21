"""Record files: checkpoints, references, reports, event lines and tables of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = "track int, start double, end double, raw_text string, languages array<struct<start:double,end:double,language:string,score:double>>"
EVENT = "type string, track int, progress double, message string"


def read_chunks(spark: SparkSession, glob: str) -> DataFrame:
    """Segment checkpoints with the name of their file, which orders them."""
    return spark.read.schema(CHUNK).json(glob).withColumn("file", F.col("_metadata.file_name"))


def language_timeline(chunks: DataFrame, limited: bool = False) -> DataFrame:
    """Per track the language stretches of its checkpoints in file order, the languages heard, and what was processed."""
    rows = F.array_sort(F.collect_list(F.struct("file", "languages")))
    timeline = F.flatten(F.transform("rows", lambda r: r["languages"]))
    return chunks.groupBy("track").agg(rows.alias("rows")).select(
        "track", timeline.alias("timeline"), F.array_sort(F.array_distinct(F.transform(timeline, lambda x: x["language"]))).alias("languages"), F.lit("processed_range" if limited else "full_track").alias("coverage")
    )


def read_references(spark: SparkSession, path: str, text: str = "transcription", fallback: str = "raw_transcription", most: int = 3) -> DataFrame:
    """The first rows of each configuration (column ``config``) of a Parquet dataset; another text column where the usual one is missing from the file."""
    rows = spark.read.parquet(path)
    named = rows.withColumn("reference", F.col(text if text in rows.columns else fallback))
    first = Window.partitionBy("config").orderBy("id")
    return named.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).drop("n")


def read_reference_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def event_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON event lines, and the lines that aren't."""
    read = lines.withColumn("event", F.from_json(column, EVENT + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    bad = F.col("event").isNull() | F.col("event.broken").isNotNull() | F.col("event.type").isNull()
    return read.filter(~bad).select("event.type", "event.track", "event.progress", "event.message"), read.filter(bad).select(column)


PULL = "status string, completed double, total double, error string"


def pull_progress(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of a download's progress beside their other columns: status, progress (0 to 1) and error. Blank lines go; lines that aren't JSON are errors."""
    read = lines.filter(F.trim(column) != "").withColumn("_p", F.from_json(column, PULL + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    share = F.least(F.lit(1.0), F.coalesce("_p.completed", F.lit(0.0)) / F.greatest(F.lit(1.0), F.coalesce("_p.total", F.lit(1.0))))
    error = F.coalesce("_p.error", F.when(F.col("_p").isNull() | F.col("_p.broken").isNotNull(), F.concat(F.lit("unreadable: "), F.col(column))))
    return read.select(*[c for c in lines.columns if c != column], F.coalesce("_p.status", F.lit("Downloading")).alias("status"), share.alias("progress"), error.alias("error"))


def encoder_progress(line: F.Column, duration: F.Column) -> F.Column:
    """Share done, 0 to .96, of an encoder's progress line; null for other lines."""
    micros = F.regexp_extract(line, r"^out_time_us=(\d+)$", 1).try_cast("double")
    return F.when(micros.isNotNull(), F.least(F.lit(0.96), F.greatest(F.lit(0.0), micros / 1e6 / F.greatest(duration, F.lit(0.001)))))


def gpu_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, total and used MB, and load of comma-separated device lines."""
    return lines.select(F.from_csv(column, "name string, total_mb double, used_mb double, load double", {"ignoreLeadingWhiteSpace": "true"}).alias("r")).select("r.*")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("error").json(path)
