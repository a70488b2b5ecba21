"""Order over ranges: running sums and places in groups of any size.

A group may hold a third of all rows, so nothing here puts a group in one task. Rows are sorted
over ranges of keys and order, and written with the part they fell in; sums run inside the parts,
and the sums of whole parts, few rows a group, say where each part begins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one is made and set only where driver and executors are one process."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="cuelark-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder: what follows sees one and the same content, whatever executors are lost."""
    path = f"{shared_folder(rows.sparkSession)}/cuelark/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys; null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def laid(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``rows`` sorted by keys and order over ranges, with ``_row``, which grows along the sort, and ``_part``, the range."""
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return written(ordered.withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))


def part_bases(totals: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Totals of parts (keys, _part, names) as sums over the parts before, ``base_`` and the name. A group has few parts."""
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"base_{n}") for n in names])


def running(rows: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums, this row's value included, along ``order`` within ``keys``. Null keys form a group; null values count as nothing.

    Rows that are equal in ``order`` follow each other in any order.
    """
    names = list(sums)
    values = rows.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_{n}") for n, c in sums.items()])
    table = laid(values, keys, order)
    bases = written(part_bases(table.groupBy(*keys, "_part").agg(*[F.sum(f"_{n}").alias(n) for n in names]), keys, names))
    inside = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = table.select("*", *[F.sum(f"_{n}").over(inside).alias(n) for n in names])
    joined = local.join(bases.withColumnRenamed("_part", "_of"), same(local, bases, keys) & (F.col("_part") == F.col("_of")))
    return joined.select(*[local[c] for c in rows.columns], *[(local[n] + bases[f"base_{n}"]).alias(n) for n in names])


def placed(rows: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """Adds the place of each row in its group, from 0."""
    return running(rows, keys, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)
