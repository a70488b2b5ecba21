"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of the labelled rows. A text is a TF-IDF vector of unit length over
all its words; words that no example holds count in its length. Terms whose document frequency
differs between the labels beyond chance weigh more than others, and word beginnings are terms
where they differ so. The examples' inverted index keeps, for every term and block of examples, the
largest weight in the block. A search adds up these maxima to a bound per block, visits blocks by
falling bound, summing their own postings alone, and stops where bounds lie below the k-th
similarity found: the k nearest are exact. Their labels vote,
nearer ones more, and a monotone curve fitted on the examples (each searched without itself) turns
votes into probabilities.

The index is bounded by the sample, so it is broadcast; texts are scored where they lie.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc, keep, restored, solid

#: At most so many labelled rows become examples; nearest examples that vote.
EXAMPLES, NEAREST = 4096, 15
#: A term in so many examples with so large a chi-square statistic (1 degree of freedom: about 1 in 10 million by chance) has its
#: whole weight; any other term this share of it.
LEAST_EXAMPLES, LEAST_CHI2, OTHER = 5, 28.0, 0.3
BLOCK = 64
#: Blocks that are visited first, and how many times more each time after.
FIRST, MORE = 6, 4
#: Texts whose result a task remembers.
KNOWN = 5_000
#: Bytes of a word's beginning.
BEGINNINGS = (5, 7)
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case; anything beyond ASCII counts as a letter."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def features(words: set[bytes]) -> set[bytes]:
    """Words, and the beginnings (first bytes, marked) of longer ones."""
    return words | {w[:n] + b"*" for n in BEGINNINGS for w in words if len(w) > n}


def _example_words(batches):
    for b in batches:
        rows = []
        for text, y in zip(b["text"], b["y"]):
            rows += [(w, y) for w in features(set(words_of(text)))]
        yield pd.DataFrame(rows, columns=["word", "y"])


class Terms:
    """Terms of the examples: their places, and their weights without term frequency. Beginnings end in a star."""

    def __init__(self, weight: dict[bytes, float], unseen: float):
        self.at = {t: i for i, t in enumerate(weight)}
        self.weight = np.array(list(weight.values()))
        self.unseen = unseen
        self.begins = [(k, {t[:-1]: i for t, i in self.at.items() if len(t) == k + 1 and t.endswith(b"*")}) for k in BEGINNINGS]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(term, weight) of a text, a unit vector but for the words that no example holds."""
        words = Counter(words_of(text))
        times = np.fromiter(words.values(), "float64", len(words))
        at = np.fromiter(map(self.at.get, words, repeat(-1)), "int64", len(words))
        lost = 1 + np.log(times[at < 0])
        at, times = at[at >= 0], times[at >= 0]
        for k, table in self.begins:
            begun = [(t, n) for w, n in words.items() if len(w) > k and (t := table.get(w[:k])) is not None] if table else []
            if begun:
                at, times = np.append(at, [t for t, _ in begun]), np.append(times, [n for _, n in begun])
        at, where = np.unique(at, return_inverse=True)
        w = (1 + np.log(np.bincount(where, times, len(at)))) * self.weight[at]
        size = math.sqrt(float(w @ w) + float(lost @ lost) * self.unseen * self.unseen)
        return at, w / size if size else w


def alike(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, least: int) -> list[int]:
    """An order of vectors in which neighbours are alike: halves along the direction that tells them apart most, down to blocks of ``least``."""
    out: list[int] = []

    def halve(mine: list[int]) -> None:
        if len(mine) <= least:
            out.extend(mine)
            return
        who = np.repeat(np.arange(len(mine)), [len(vectors[i][0]) for i in mine])
        term, weight = (np.concatenate([vectors[i][part] for i in mine]) for part in (0, 1))
        x = np.random.RandomState(1).randn(len(mine))
        for _ in range(12):  # power iteration
            x = np.bincount(who, weight * np.bincount(term, weight * (x - x.mean())[who], terms)[term], len(mine))
            x /= np.linalg.norm(x) or 1.0
        order = np.argsort(x, kind="stable").tolist()
        half = -(-len(mine) // (2 * least)) * least
        halve([mine[i] for i in order[:half]])
        halve([mine[i] for i in order[half:]])

    halve(list(range(len(vectors))))
    return out


class Index:
    """Block-max inverted index of vectors; examples are ordered so that blocks are alike inside."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        order = alike(vectors, terms, BLOCK)
        self.ids = np.array([ids[i] for i in order], "int64")
        self.labels = np.array([labels[i] for i in order], "float64")
        self.place = {int(x): i for i, x in enumerate(self.ids)}
        self.size = BLOCK
        #: Postings summed so far.
        self.summed = 0
        self.blocks = -(-len(order) // self.size)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, "int64")
        who = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order]) if order else np.zeros(0, "int64")
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        by = np.lexsort((who, term))
        term, self.who, self.weight = term[by], who[by].astype("int32"), weight[by]
        self.start = np.searchsorted(term, np.arange(terms + 1))
        # for each term and block that meet: where their postings begin, and the largest weight among them
        pair = term * max(1, self.blocks) + self.who // self.size
        self.pair, first = np.unique(pair, return_index=True)
        self.peak = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.begin = np.append(first, len(pair))
        self.row = np.searchsorted(self.pair, np.arange(terms + 1) * max(1, self.blocks))

    @staticmethod
    def _stretches(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of stretches, and the sizes of these."""
        size = hi - lo
        return np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size), size

    def _sums(self, weights: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Similarity to every example over a stretch of the postings for each weight."""
        at, size = self._stretches(lo, hi)
        self.summed += len(at)
        return np.bincount(self.who[at], self.weight[at] * np.repeat(weights, size), self.blocks * self.size)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and positions of the k nearest, nearest first, ties by id; only similarities above zero.

        Blocks are visited by falling bound, a few first and then more at a time, and only their own
        postings are summed. Once a bound lies below the k-th similarity so far, no other block counts.
        """
        none = np.zeros(0), np.zeros(0, "int64")
        if not len(terms) or not self.blocks:
            return none
        pairs, size = self._stretches(self.row[terms], self.row[terms + 1])
        block, weight = self.pair[pairs] % self.blocks, np.repeat(weights, size)
        # a similarity that no example of the block exceeds
        bound = np.bincount(block, self.peak[pairs] * weight, self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        sums, least, near, at, step = np.zeros(self.blocks * self.size), 0.0, np.zeros(0, "int64"), 0, FIRST
        while at < len(order):
            now = order[at : at + step]
            now = now[bound[now] >= least - 1e-11]
            if not len(now):
                break
            if len(now) == self.blocks:
                sums += self._sums(weights, self.start[terms], self.start[terms + 1])
            else:
                inside = np.zeros(self.blocks, bool)
                inside[now] = True
                mine = inside[block]
                sums += self._sums(weight[mine], self.begin[pairs[mine]], self.begin[pairs[mine] + 1])
            if skip is not None:
                sums[skip] = 0.0
            near = np.flatnonzero(sums)
            if len(near) >= k:
                least = np.partition(sums[near], len(near) - k)[len(near) - k]
            at, step = at + step, step * MORE
        if len(near) > k:  # the k-th largest and all that may round to it
            near = near[sums[near] >= least - 1e-11]
        shown = np.round(sums[near], 12)
        near = near[np.lexsort((self.ids[near], -shown))[:k]]
        return np.round(sums[near], 12), near

    def vote(self, similarity: np.ndarray, at: np.ndarray, rate: float) -> float:
        """Share of label 1 among the nearest, by inverse distance, with one far vote of the general rate."""
        w = 1 / (1.05 - np.minimum(similarity, 1.0))
        return round(float((w @ self.labels[at] + rate) / (w.sum() + 1)), 12)


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares nondecreasing steps through (x, y): pooled x (means) and levels."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][2] / pools[-2][1] == pools[-1][2] / pools[-1][1]):
            s, n, t = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + t]
    return np.array([t / n for _, n, t in pools]), np.array([(s + 0.5 * (s / n)) / (n + 0.5) for s, n, _ in pools])


def _votes(shared):
    """Each indexed example's vote when it is searched without itself."""

    def run(batches):
        index, terms, rate, *_ = shared.value
        for b in batches:
            votes = [index.vote(*index.nearest(*terms.vector(text), NEAREST, index.place[one]), rate) for one, text in zip(b["doc_id"], b["text"])]
            yield b[["y"]].assign(vote=votes)

    return run


def _vectors(shared):
    def run(batches):
        terms = shared.value
        for b in batches:
            both = [terms.vector(text) for text in b["text"]]
            yield b[["doc_id", "y"]].assign(terms=[t.tolist() for t, _ in both], weights=[w.tolist() for _, w in both])

    return run


def _scores(shared):
    def run(batches):
        index, terms, rate, plain, curve = shared.value
        known: dict = {}
        for b in batches:
            out, ids, labels, sims = [], [], [], []
            for text in b["text"]:
                key = xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
                if key not in known:
                    if len(known) > KNOWN:
                        known.clear()
                    s, i = index.nearest(*terms.vector(text), NEAREST)
                    p = float(np.interp(index.vote(s, i, rate), *curve)) if len(i) else plain
                    known[key] = (p, index.ids[i[:3]].tolist(), index.labels[i[:3]].astype("int64").tolist(), s[:3].tolist())
                p, x, y, s = known[key]
                out.append(min(1.0, max(0.0, p)))
                ids.append(x)
                labels.append(y)
                sims.append(s)
            yield b.drop(columns="text").assign(score=out, evidence_ids=ids, evidence_labels=labels, evidence_similarities=sims)

    return run


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held_fold: int = 1, examples: int = EXAMPLES):
    """Broadcast (index, terms, rates, curve), bounded by the texts of ``examples`` rows.

    Labels are read only for rows whose crc32(doc_id as text) mod ``folds`` isn't ``held_fold``;
    of these at most ``examples`` become examples, by the order of a hash of the id. Repeated
    label rows of an id count as 1 if one of them is 1; rows with a null id or label teach nothing.
    """
    spark = docs.sparkSession
    taught = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null and y in (0, 1)")
    taught = taught.filter((crc(F.col("doc_id")) % folds) != held_fold).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)  # at most so many ids and labels
    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    some = keep(some.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), "examples")
    many, toxic = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    rate = toxic / many if many else 0.0
    a, n1 = F.col("toxic").cast("double"), float(toxic)
    b, n0 = F.col("df") - F.col("toxic"), float(many - toxic)
    df = F.col("df").cast("double")
    chi2 = F.when((df < many) & F.lit(0 < n1 < many), F.lit(float(many)) * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2.0)) / F.greatest(df * (many - df) * n1 * n0, F.lit(1e-9))).otherwise(0.0)
    counted = some.select("text", "y").mapInPandas(_example_words, "word binary, y int").groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("toxic"))
    differs = (df >= LEAST_EXAMPLES) & (chi2 >= LEAST_CHI2)
    # words of the examples' texts, and beginnings that differ between the labels
    rows = counted.withColumn("differs", differs).filter(F.col("differs") | ~F.endswith("word", F.lit(b"*"))).orderBy("word").select("word", "df", "differs").toArrow().to_pylist()
    idf = lambda n: math.log((1 + many) / (1 + n)) + 1
    terms = Terms({r["word"]: idf(r["df"]) * (1.0 if r["differs"] else OTHER) for r in rows}, idf(0) * OTHER)
    shared = spark.sparkContext.broadcast(terms)
    vectors = some.mapInPandas(_vectors(shared), "doc_id long, y int, terms array<long>, weights array<double>").toArrow().to_pylist()
    shared.destroy()
    inside = [r for r in vectors if r["terms"]]
    outside = [r["y"] for r in vectors if not r["terms"]]
    plain = (sum(outside) + rate) / (len(outside) + 1) if many else 0.0
    index = Index([r["doc_id"] for r in inside], [r["y"] for r in inside], [(np.array(r["terms"], "int64"), np.array(r["weights"])) for r in inside], len(rows))
    curve = (np.array([0.0]), np.array([plain]))
    if inside:
        shared = spark.sparkContext.broadcast((index, terms, rate))
        there = some.repartition(spark.sparkContext.defaultParallelism, "doc_id").filter(F.col("doc_id").isin([r["doc_id"] for r in inside]) if outside else F.lit(True))
        seen = there.mapInPandas(_votes(shared), "y int, vote double").toPandas()
        shared.destroy()
        curve = monotone(seen["vote"].to_numpy(), seen["y"].to_numpy("float64"))
    return spark.sparkContext.broadcast((index, terms, rate, plain, curve))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held_fold: int = 1, threshold: float = 0.7, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the three nearest examples (ids, labels, similarities) of every row.

    A row's score depends on its text alone (and on the examples, see :func:`train`). A text that
    shares no term with an example, empty and null ones included, gets the share of label 1 among
    examples without words. Without examples every score is 0.
    """
    shared = train(docs, labels, doc_id, text, label, folds, held_fold, examples)
    held = F.coalesce((crc(F.col(doc_id)) % folds) == held_fold, F.lit(False))
    evidence = "score double, evidence_ids array<long>, evidence_labels array<long>, evidence_similarities array<double>"
    source = docs.select(solid(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    scored = source.mapInPandas(_scores(shared), f"doc_id long, held_out boolean, {evidence}")
    return scored.select(restored("doc_id").alias("doc_id"), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence_ids", "evidence_labels", "evidence_similarities")


def _below(shared, text: str, threshold: float):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = pd.DataFrame({"text": b.column(b.schema.get_field_index(text)).to_pylist()})
            score = next(_scores(shared)(iter([texts])))["score"] if len(texts) else []
            yield b.filter(pa.array([x < threshold for x in score], pa.bool_()))

    return run


def reject(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns as they are."""
    return docs.mapInArrow(_below(train(docs, labels, doc_id, text, **options), text, threshold), docs.schema)
