"""What the operators of this subpackage share: tables, the shared folder, small hash helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # whole texts go to Python workers in batches: fewer rows keep a batch of long texts small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and driver and
    executors are one process (local tests) a temporary folder is made and set.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="cuelark-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from the table,
    so a lost executor costs only the step that runs, and lineage stays short."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuelark/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`keep` wrote and no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc(col) -> "F.Column":
    """crc32 of a value written as text."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


#: Stands for a null id on the way through pandas, which would turn long columns with nulls into floats.
NO_ID = -(2**63)


def solid(col) -> "F.Column":
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("long"), F.lit(NO_ID))


def restored(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != NO_ID, c)
