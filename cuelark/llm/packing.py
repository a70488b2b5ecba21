"""Harmonic packing of token ids into fixed sequences.

A piece of length r belongs to the reciprocal class k = capacity div r: k such pieces fit in a
bin, and every bin of class k takes exactly k of them. Documents may be cut freely, so a
remainder that would leave its slot slack is first cut by the exact slot of class k + 1, which
that class fills without waste. Bins are arithmetic on a piece's number in its class: its number
inside its task plus a prefix sum of the tasks' counts. No piece needs to see another one.

A class leaves at most one unfilled bin, so what is left over is at most the sum of k - 1 over
the 2 * sqrt(capacity) classes (about 10,000 pieces for 2048) whatever the input; it is packed by
first-fit decreasing.

Ids are those of a tokenizer's JSON file: its added tokens are cut out of the text first, the rest
is merged by the ranks of the same vocabulary, which takes a quarter of the time.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import keep, restored, solid

CAPACITY = 2048
#: A piece is left uncut if it fills its slot but for this share.
SLACK = 0.02


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(tokenizer_path: str, ranks_path: str) -> tiktoken.Encoding:
    """The tokenizer of a byte-level BPE JSON file without a normalizer, whose merges the rank file holds."""
    with open(tokenizer_path, encoding="utf-8") as f:
        own = json.load(f)
    added = own["added_tokens"]
    if own["normalizer"] or any(t[x] for t in added for x in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens of this tokenizer do not stand for their own text alone")
    return tiktoken.Encoding("json", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.ranks(ranks_path), special_tokens={t["content"]: t["id"] for t in added})


@lru_cache(maxsize=None)
def cut(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of a remainder below the capacity, in order."""
    out = []
    while length:
        k = capacity // length
        slot = capacity // k
        if slot - length <= slack * slot:
            out.append((length, k))
            break
        part = capacity // (k + 1)
        out.append((part, capacity // part))
        length -= part
    return tuple(out)


def _pieces(tokenizer_path: str, ranks_path: str, end_id: int, capacity: int, slack: float):
    def run(batches):
        encode = encoder(tokenizer_path, ranks_path).encode_to_numpy
        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = encode(text, allowed_special="all")
                data = ids.astype("<u4").tobytes() + int(end_id).to_bytes(4, "little")
                total, at = len(ids) + 1, 0
                for n, k in [(capacity, 1)] * (total // capacity) + list(cut(total % capacity, capacity, slack)):
                    seen[k] = no = seen.get(k, -1) + 1
                    rows.append((doc, at, n, zlib.crc32(data[4 * at : 4 * (at + n)]), total, k, task, no))
                    at += n
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "task", "no"])

    return run


def _first_fit(capacity: int):
    def run(left: pd.DataFrame) -> pd.DataFrame:
        left = left.drop(columns="all").sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        room: list[int] = []
        bins = []
        for n in left["length"]:
            i = next((i for i, r in enumerate(room) if r >= n), len(room))
            if i == len(room):
                room.append(capacity)
            room[i] -= n
            bins.append(i)
        left["bin"] = pd.Series(bins, dtype="int64")
        left["rank"] = left.index
        return left

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, ranks_path: str | None = None, end_id: int = 1, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows.

    A null text is empty and yields the end id alone. Repeated rows are packed each on their own;
    a null doc_id stays null. ``offset`` is gapless from 0 in each sequence.
    """
    tokenizer_path, ranks_path = tokenizer_path or default_tokenizer(), ranks_path or bpe.default_ranks()
    source = docs.select(solid(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, task int, no long"
    pieces = keep(source.mapInPandas(_pieces(tokenizer_path, ranks_path, end_id, capacity, slack), shape), "pieces")
    counts = pieces.groupBy("task", "k").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("k").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row per class: at most 2 * sqrt(capacity)
    totals = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    first, bins = {}, 0
    for k in sorted(totals):
        first[k], bins = bins, bins + totals[k] // k
    if not totals:
        first, totals = {0: 0}, {0: 0}
    lookup = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv]), F.col("k"))
    ranked = pieces.join(bases, ["task", "k"]).withColumn("rank", F.col("base") + F.col("no"))
    full = F.col("rank") < lookup({k: n // k * k if k else 0 for k, n in totals.items()}).cast("long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    filled = ranked.filter(full).select(*columns, "rank", (lookup(first).cast("long") + F.floor(F.col("rank") / F.col("k"))).alias("sequence_id"))
    rest = (
        ranked.filter(~full)
        .select(*columns, F.lit(0).alias("all"))
        .groupBy("all")
        .applyInPandas(_first_fit(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin long, rank long")
        .select(*columns, "rank", (F.col("bin") + bins).alias("sequence_id"))
    )
    order = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return filled.unionByName(rest).select(restored("doc_id").alias("doc_id"), *columns[1:], "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
