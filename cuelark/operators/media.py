"""Media documents: probe JSON to typed streams, files to listings and fingerprints."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBE = (
    "struct<format:struct<duration:string,size:string>,streams:array<struct<index:int,codec_type:string,codec_name:string,channels:int,channel_layout:string,"
    "width:int,height:int,duration:string,start_time:string,tags:map<string,string>,disposition:map<string,int>>>>"
)


def streams(probes: DataFrame) -> DataFrame:
    """Rows (path, body JSON) to one row a stream, with its place among streams of its type; attached pictures aren't video."""
    each = probes.select("path", F.explode(F.from_json("body", PROBE)["streams"]).alias("s")).select("path", "s.*")
    picture = (F.col("codec_type") == "video") & (F.coalesce(F.element_at("disposition", "attached_pic"), F.lit(0)) == 1)
    order = Window.partitionBy("path", "codec_type").orderBy("index")
    return each.filter(~picture).withColumn("ordinal", F.row_number().over(order) - 1)


def durations(probes: DataFrame) -> DataFrame:
    """Duration of the container, or of its longest stream where it has none."""
    doc = probes.select("path", F.from_json("body", PROBE).alias("d"))
    whole = F.expr("try_cast(d.format.duration as double)")
    longest = F.array_max(F.transform("d.streams", lambda s: F.coalesce(s["duration"].try_cast("double"), F.lit(0.0))))
    return doc.select("path", F.coalesce(F.when(whole > 0, whole), longest, F.lit(0.0)).alias("duration"))


def list_files(files: DataFrame, extensions: list[str], query: str = "", offset: int = 0, limit: int = 200) -> DataFrame:
    """A page of a listing (name, path, kind, size): folders first, then files of these extensions by name; totals beside each row."""
    named = files.filter(F.contains(F.lower("name"), F.lit(query.lower())))
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    good = (F.col("kind") == "folder") | suffix.isin(extensions)
    totals = F.broadcast(named.agg(F.count_if(good).alias("total"), F.count_if(~good).alias("skipped")))  # one row
    return named.filter(good).orderBy(F.col("kind") != "folder", F.lower("name"), "name").offset(offset).limit(limit).join(totals)


def locations(rows: DataFrame) -> DataFrame:
    """Shortcuts (position, label, path), each place once: the first of equal normalized paths stays."""
    key = F.lower(F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "/+$", ""))
    first = Window.partitionBy("key").orderBy("position")
    return rows.withColumn("key", key).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "key")


@F.pandas_udf(T.StringType())
def file_fingerprint(path: pd.Series, size: pd.Series, modified_ns: pd.Series) -> pd.Series:
    """SHA-256 over path, size, time and the first and last MiB of files that all workers can open; null where one can't."""

    def one(p: str, n: int, t: int) -> str | None:
        h = hashlib.sha256(f"{p}|{n}|{t}".encode())
        try:
            with open(p, "rb") as f:
                h.update(f.read(1 << 20))
                f.seek(max(0, os.path.getsize(p) - (1 << 20)))
                h.update(f.read(1 << 20))
        except OSError:
            return None
        return h.hexdigest()

    return pd.Series([one(*x) for x in zip(path, size, modified_ns)])


def content_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def output_allowed(target: Column, source: Column, suffixes: list[str]) -> Column:
    """An absolute path with one of the suffixes that isn't the source."""
    return target.startswith("/") & F.lower(F.regexp_extract(target, r"(\.[^./]+)$", 1)).isin(suffixes) & (target != source)
