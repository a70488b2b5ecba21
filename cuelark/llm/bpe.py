"""Byte-level BPE encoding and decoding.

Encoding: every text is cut into pre-tokens with their positions; the distinct words of each text
cross one global exchange by word, sorted by word, so that each distinct word is encoded once and
its ids are joined to all its rows; they return to their documents and are put in by position.
Frequent words would be hot keys of that exchange, so a bounded table of them is broadcast with
its ids instead. Which words those are is decided on a bounded sample of texts; that choice only
sets a word's route, never its ids, and every word of every text is encoded.
Decoding: ids are joined with the token-byte table, a DataFrame as large as the vocabulary and so
broadcast; the join runs on whole arrays of ids, because a row a token would be many times the input.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, restored, solid

#: About so many words are broadcast, whatever the input (about 60 MB in a worker), chosen on about so many texts.
HEAD_WORDS, SAMPLE = 400_000, 65_536
#: A task's counts are handed on when it holds so many words.
FLUSH = 400_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str | None = None) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern or default_pattern(), mergeable_ranks=ranks(path), special_tokens={})


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The token-byte table (id, token) of a rank file."""
    return spark.createDataFrame(sorted((i, t) for t, i in ranks(path or default_ranks()).items()), "id int, token binary")


#: The usual pattern of rank files, and what it matches in a text of ASCII alone, without Unicode classes.
_USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern; texts of ASCII alone take a cheaper form of the usual one."""
    every = regex.compile(pattern).findall
    if pattern != _USUAL:
        return every
    plain = re.compile(_ASCII).findall
    return lambda text: plain(text) if text.isascii() else every(text)


def _count(pattern: str):
    def run(batches):
        find, seen = splitter(pattern), Counter()

        def flush():
            some = pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": np.fromiter(seen.values(), "int64", len(seen))})
            seen.clear()
            return some

        for b in batches:
            for text in b["text"]:
                seen.update(find(text))
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    return run


def _encode(ranks_path: str, pattern: str):
    """Adds ids (little-endian unsigned 32-bit) to rows sorted by word: one encoding for each word of a task."""

    def run(batches):
        enc, last, ids = encoder(ranks_path, pattern), None, b""
        for b in batches:
            out = []
            for w in b["word"]:
                if w != last:
                    last, ids = w, np.array(enc.encode_ordinary(w), "<u4").tobytes()
                out.append(ids)
            yield b.assign(ids=out).drop(columns="word")

    return run


def head_words(texts: DataFrame, ranks_path: str, pattern: str, most: int = HEAD_WORDS, sample: int = SAMPLE) -> tuple[dict[str, int], np.ndarray]:
    """Frequent words of about ``sample`` texts by rank, and the ids of each rank: about the ``most`` most frequent ones."""
    share = min(1.0, sample / max(1, texts.count()))
    some = texts.select("text") if share == 1 else texts.select("text").sample(share, 7)
    # a word seen once gains nothing from the broadcast; it takes the exchange
    words = keep(some.mapInPandas(_count(pattern), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "words")
    level = F.floor(F.log(F.col("n").cast("double")) * 10)
    least, total, part = None, 0, 1
    for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():
        least, total, above = r["level"], total + r["words"], total
        if total > most:  # the last level fills what room is left, by a hash of the word
            part = -(-r["words"] // max(1, most - above))
            break
    if least is None or not most:
        return {}, np.empty(0, object)
    words = words.filter((level > least) | ((level == least) & (F.pmod(F.xxhash64("word"), F.lit(part)) == 0)))
    top = words.select("word", F.col("word").alias("key"), "n").mapInPandas(_encode(ranks_path, pattern), "key string, n long, ids binary").toArrow()
    top = top.sort_by([("n", "descending"), ("key", "ascending")])
    ids = np.empty(len(top), object)
    ids[:] = top["ids"].to_pylist()
    return {w.as_py(): i for i, w in enumerate(top["key"])}, ids


def _tail(pattern: str, head):
    """Rows (doc_id, mark, slot, word): the distinct words of each text that the broadcast lacks, by first position."""

    def run(batches):
        find, known = splitter(pattern), head.value[0]
        for t in batches:
            rows = []
            for doc, mark, text in zip(t["doc_id"], t["mark"], t["text"]):
                rows += [(doc, mark, i, w) for i, w in enumerate(w for w in dict.fromkeys(find(text)) if w not in known)]
            yield pd.DataFrame(rows, columns=["doc_id", "mark", "slot", "word"])

    return run


def _skeleton(pattern: str, head):
    """Per text, pressed: the ranks of its broadcast words, and the places of its other words with the slot that each takes.

    Ranks are two bytes, the rare ones above 65,534 four more; low and high bytes lie apart, which presses better.
    """

    def run(batches):
        find, rank, press = splitter(pattern), head.value[0].get, zstandard.ZstdCompressor(level=3).compress
        for t in batches:
            blobs = []
            for text in t["text"]:
                words = find(text)
                at = np.array(list(map(rank, words, repeat(-1))), "int64")
                gaps = np.flatnonzero(at < 0)
                own: dict[str, int] = {}
                slots = [own.setdefault(words[i], len(own)) for i in gaps.tolist()]
                at = at[at >= 0]
                rare = at[at >= 65_535].astype("<u4")
                near = np.minimum(at, 65_535).astype("<u2").view("u1").reshape(-1, 2)
                sizes = np.array([len(at), len(rare), len(gaps), len(own)], "<u4")
                places = np.diff(gaps, prepend=0).astype("<u4").view("u1").reshape(-1, 4), np.array(slots, "<u4").view("u1").reshape(-1, 4)
                blobs.append(press(b"".join(x.tobytes() for x in (sizes, near.T.copy(), rare, places[0].T.copy(), places[1].T.copy()))))
            yield t.drop(columns="text").assign(blob=blobs)

    return run


def _assemble(head):
    """Puts the ids of a text together from its skeleton and the ids of its other words (``found``: slot, ids)."""

    def run(batches):
        table, pull = head.value[1], zstandard.ZstdDecompressor().decompress
        for t in batches:
            out = []
            for blob, found in zip(t["blob"], t["found"]):
                raw = np.frombuffer(pull(blob), "u1")
                n, rare, gaps, slots = raw[:16].view("<u4").tolist()
                ends = np.cumsum([16, 2 * n, 4 * rare, 4 * gaps, 4 * gaps])
                near, far, place, slot = (raw[a:b] for a, b in zip(ends, ends[1:]))
                at = near.reshape(2, -1).T.copy().view("<u2").ravel().astype("int64")
                at[at == 65_535] = far.copy().view("<u4")
                words = np.empty(n + gaps, object)
                if gaps:
                    ids = {r["slot"]: r["ids"] for r in found}
                    if len(ids) != slots:
                        raise ValueError("words of a text did not come back")
                    other = np.zeros(n + gaps, bool)
                    other[np.cumsum(place.reshape(4, -1).T.copy().view("<u4").ravel(), dtype="int64")] = True
                    words[other] = [ids[s] for s in slot.reshape(4, -1).T.copy().view("<u4").ravel().tolist()]
                    words[~other] = table[at]
                else:
                    words[:] = table[at]
                out.append(b"".join(words.tolist()))
            yield t[["doc_id"]].assign(ids=out)

    return run


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None, head_limit: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, ids) of every row, doc_id as long; ids are little-endian unsigned 32-bit integers in a binary.

    A null text is empty and has no ids. Only where ids repeat, rows are told apart by a hash of
    their text as well, so rows that repeat an id, or have none, each return their own row.
    """
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    source = docs.select(solid(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    repeated = bool(source.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1))
    source = source.withColumn("mark", F.xxhash64("text") if repeated else F.lit(0).cast("long")).select("doc_id", "mark", "text")
    head = docs.sparkSession.sparkContext.broadcast(head_words(source, ranks_path, pattern, head_limit))
    tails = (
        source.mapInPandas(_tail(pattern, head), "doc_id long, mark long, slot int, word string")
        .repartition("word")
        .sortWithinPartitions("word")
        .mapInPandas(_encode(ranks_path, pattern), "doc_id long, mark long, slot int, ids binary")
        .repartition("doc_id", "mark")  # rows are smaller than partly collected lists
        .groupBy("doc_id", "mark")
        .agg(F.collect_list(F.struct("slot", "ids")).alias("found"))
    )
    skeleton = source.mapInPandas(_skeleton(pattern, head), "doc_id long, mark long, blob binary")
    joined = skeleton.join(tails, ["doc_id", "mark"], "left").select("doc_id", "blob", "found")
    return joined.mapInPandas(_assemble(head), "doc_id long, ids binary").select(restored("doc_id").alias("doc_id"), "ids")


def _decode(tokens):
    import pyarrow as pa

    def run(batches):
        table = tokens.value
        for t in batches:
            ids = t.column(t.schema.get_field_index("ids"))
            data = [b"".join(table[np.frombuffer(x, "<u4")].tolist()) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(data, pa.binary())], names=[*t.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Adds ``decoded`` (bytes) to rows with ``ids``, beside their other columns.

    ``tokens`` (id, token) is the token-byte table, of the rank file if not given; an id that it
    lacks fails the task.
    """
    from pyspark.sql.types import BinaryType, StructType

    rows = (token_table(encoded.sparkSession) if tokens is None else tokens).collect()  # the vocabulary
    table = np.full(max((r["id"] for r in rows), default=-1) + 1, None, object)
    for r in rows:
        table[r["id"]] = bytes(r["token"])
    return encoded.mapInArrow(_decode(encoded.sparkSession.sparkContext.broadcast(table)), StructType([*encoded.schema.fields]).add("decoded", BinaryType()))


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
