"""Documents to packed sequences: toxic ones go, one of each near-duplicate group stays, secrets are masked, the rest is packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelark.llm import neardup, packing, secrets, toxicity
from cuelark.llm.common import keep, shared_dir, table


#: Numbers the rows of a stage; no column of documents has this name.
ROW = "_cuelark_row"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; of each group the row with the smallest doc_id stays (null last).

    Rows, not ids, are judged and dropped: each row has a number of its own here, so rows that
    repeat an id with another text stay, and of rows that repeat a text one stays. Texts without
    words belong to no group.
    """
    rows = keep(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    found = neardup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), words=5, percent=80)
    named = keep(found.select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, "doc_id").hint("merge"), ROW), "named")
    groups = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = named.join(groups.hint("merge"), "component_id").filter(F.col(ROW) != F.col("first")).select(ROW)
    return rows.join(gone.hint("merge"), ROW, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding becomes ``[secret]``; n_chars follows the text. Texts without findings stay as they are.

    The ledger lies where ``cuelark.ledger`` says, so that later runs scan only texts that no run has
    seen; without that setting a run has a ledger of its own.
    """
    versions = secrets.address(docs, "doc_id", "text")
    ledger = secrets.Ledger(spark, spark.conf.get("cuelark.ledger", None) or f"{shared_dir(spark)}/cuelark/{uuid.uuid4().hex}/ledger")
    ledger.scan(versions)
    found = secrets.findings_by_blob(ledger.findings())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    named = secrets.joined(rows, found)
    hit = F.col("found").isNotNull()
    masked = F.when(hit, secrets.redact(F.col("found"), F.col("row.text"))).otherwise(F.col("row.text"))
    named = named.withColumn("masked", masked)
    new = {"text": F.col("masked"), "n_chars": F.when(hit, F.length("masked").cast("long")).otherwise(F.col("row.n_chars"))}
    return named.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("near duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("packing", pack)]

#: Near-duplicate components and tokens have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
