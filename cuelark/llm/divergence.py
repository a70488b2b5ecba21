"""How far the sources of a language differ in their words, on exact integers.

1. Terms are counted where the documents lie: each task sums over its batches before anything is
   shuffled. One shuffle by language and term brings the counts of a term's sources together and
   decides which terms the language keeps.
2. A block is a share of the kept terms, by hash; as many as there is work for. For each language of a block a task fills dense
   int64 tiles, sources by terms, and broadcasts every source's row against all rows of the tile.
   Its pair matrix is summed over its tiles; only the matrix leaves the task. Sources beyond
   ``ROWS`` are split over several tasks a block, each with some rows of the matrix.
3. Partial matrices are summed; the best terms that a task found for a group are merged.

Shares are p = 1 + floor(SCALE * (count + 1) / (N + V)), distances floor((p - q)**2 / q). The long
division runs in three steps, exact below 9e15 words a language.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, keep

SCALE = 1_000_000_000
#: Documents of a language that must hold a term, and terms listed for a group.
LEAST_DOCS, BEST = 3, 200
#: Cells of a tile; sources whose rows of the pair matrix one task makes; cells of pairs that a block should have; and
#: terms that it has at least for each pair it hands out, on average.
TILE, ROWS, WORK, TERMS = 65_536, 256, 8_000_000, 1000
#: Counts that a task holds before it passes them on.
HELD = 600_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
COUNT = "lang string, source string, term string, n long, docs long"


def _count(batches):
    """Occurrences of terms, and documents that hold them, by group; a null term for each group that occurs."""
    held: dict = {}
    size = 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            terms = [t.decode("utf-8", "replace") for t in n]
            out = pd.DataFrame({"lang": lang, "source": source, "term": [None, *terms], "n": np.r_[0, np.fromiter(n.values(), "int64", len(n))], "docs": [0, *map(docs.__getitem__, n)]})
            yield out.astype({"n": "int64", "docs": "int64"})

    for b in batches:
        for lang, source, text in zip(b["lang"].tolist(), b["source"].tolist(), b["text"].tolist()):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.encode("utf-8", "replace").translate(_LETTERS).split()
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size > HELD:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, first) of the terms that a language keeps, ``first`` 1 on one row a language and term; and a row with a null term for every group."""
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    there = filled.mapInPandas(_count, COUNT).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = there.withColumn("in_docs", F.sum("docs").over(term)).withColumn("first", (F.row_number().over(term.orderBy("source")) == 1).cast("long"))
    return kept.filter((F.col("in_docs") >= least) | F.col("term").isNull()).select("lang", "source", "term", "n", "first")


def share(count: np.ndarray, whole) -> np.ndarray:
    """1 + floor(SCALE * count / whole), by long division in steps of 1000."""
    out, rest = count // whole, count % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return 1 + out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Language:
    """The pair matrix of one language in one block, for some of its sources, and the best terms of these."""

    def __init__(self, lang: str, head: pd.DataFrame, row: int, best: int, rows: int, tile: int):
        head = head.sort_values("place")
        self.lang, self.best, self.tile = lang, best, tile
        self.sources = head["source"].tolist()
        self.place = {s: i for i, s in enumerate(self.sources)}
        self.whole = head["n"].to_numpy("int64") + int(head["terms"].iloc[0])
        self.all = int(head["n"].sum()) + int(head["terms"].iloc[0])
        self.rows = range(row * rows, min(len(self.sources), row * rows + rows))
        self.sum = np.zeros((len(self.rows), len(self.sources)), "int64")
        self.top: dict[int, list] = defaultdict(list)

    def add(self, rows: pd.DataFrame) -> None:
        """Whole terms, all sources of each."""
        if not self.rows:
            return
        codes, terms = pd.factorize(rows["term"].to_numpy(object))
        place, n = rows["source"].map(self.place).to_numpy("int64"), rows["n"].to_numpy("int64")
        wide = max(1, self.tile // len(self.sources))
        for at in range(0, len(terms), wide):
            here = (codes >= at) & (codes < at + wide)
            tile = np.zeros((len(self.sources), min(wide, len(terms) - at)), "int64")
            np.add.at(tile, (place[here], codes[here] - at), n[here])
            p = share(tile + 1, self.whole[:, None])
            q = share(tile.sum(0) + 1, self.all)
            for i, row in enumerate(self.rows):
                self.sum[i] += distance(p[row][None, :], p).sum(1)
                more = np.flatnonzero((tile[row] > 0) & (p[row] > q))
                self._offer(row, distance(p[row][more], q[more]), [terms[at + k] for k in more])

    def _offer(self, row: int, values: np.ndarray, terms: list) -> None:
        top = self.top[row]
        if len(top) == self.best:
            good = values >= -top[-1][0]
            values, terms = values[good], [t for t, g in zip(terms, good) if g]
        if len(terms):
            self.top[row] = heapq.nsmallest(self.best, [*top, *((-v, t.encode("utf-8", "surrogatepass")) for v, t in zip(values.tolist(), terms))])

    def out(self) -> pd.DataFrame:
        one, two = np.indices(self.sum.shape)
        apart = (one + self.rows.start) != two
        pair = pd.DataFrame({"source": [self.sources[i + self.rows.start] for i in one[apart]], "part": "pair", "item": [self.sources[j] for j in two[apart]], "value": self.sum[apart]})
        term = pd.DataFrame([(self.sources[r], "term", t.decode("utf-8", "surrogatepass"), -v) for r, top in self.top.items() for v, t in top], columns=["source", "part", "item", "value"])
        return pd.concat([pair, term.astype({"value": "int64"})]).assign(lang=self.lang)[["lang", "source", "part", "item", "value"]]


def _blocks(best: int, rows: int, tile: int, enough: int = 8192):
    """Rows by block, row of tasks and language: first the sources (a null term), then the terms in order."""

    def run(batches):
        now, head, open_, language = None, [], [], None

        def step(last: bool) -> None:
            """Adds the terms that are whole: without ``last`` the final one may go on in the next batch."""
            nonlocal open_, language
            if language is None:
                language = _Language(now[2], pd.concat(head), now[1], best, rows, tile)
            held = pd.concat(open_)
            terms = held["term"].to_numpy(object)
            rest = terms == terms[-1] if not last else np.zeros(len(held), bool)
            language.add(held[~rest])
            open_ = [held[rest]]

        def close():
            # a language without terms still has its pairs, once
            if open_ or (now is not None and now[0] == 0 and not head[0]["terms"].iloc[0]):
                if open_:
                    step(True)
                yield (language or _Language(now[2], pd.concat(head), now[1], best, rows, tile)).out()

        for b in batches:
            keys = list(zip(b["block"].tolist(), b["row"].tolist(), b["lang"].tolist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if keys[lo] != now:
                    yield from close()
                    now, head, open_, language = keys[lo], [], [], None
                part = b.iloc[lo:hi]
                heads = part["term"].isna()
                if heads.any():
                    head.append(part[heads])
                if not heads.all():
                    open_.append(part[~heads])
                    if sum(map(len, open_)) > enough:
                        step(False)
        yield from close()

    return run


def n_blocks(cells: int, pairs: int) -> int:
    """Blocks for so many cells (terms by pairs of sources). Every block hands out its pairs and best terms, so their
    number follows the work alone, not the settings for shuffles: what leaves the tasks grows no faster than the terms."""
    return max(1, min(-(-cells // WORK), cells // (TERMS * max(1, pairs))))


def divergence(docs: DataFrame, least: int = LEAST_DOCS, best: int = BEST, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text).

    Part ``pair``: the distance of a source's word shares from each other source of its language.
    Part ``term``: the ``best`` terms that the source uses more than its language does. Nulls are
    empty strings; a group without terms has count 0 everywhere; a language without kept terms
    gives pairs of value 0. Equal values rank by the UTF-8 bytes of the item. Repeated rows count
    as often as they occur; an empty table gives no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    kept = keep(counts(docs, least), "kept")
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("first"))), F.lit(0)).alias("firsts"))
    lang = Window.partitionBy("lang")
    heads = keep(by_source.withColumn("terms", F.sum("firsts").over(lang)).withColumn("place", F.row_number().over(lang.orderBy("source")) - 1).drop("firsts"), "heads")
    sizes = heads.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("s"), F.max("terms").alias("v")).agg(F.max("s"), F.sum(F.col("v") * F.col("s") * F.col("s")), F.sum(F.col("s") * F.col("s"))).first()
    lines = max(1, -(-int(sizes[0] or 0) // rows))
    blocks = n_blocks(int(sizes[1] or 0), int(sizes[2] or 0))
    row = F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))
    block = F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).cast("int")
    nothing = F.lit(None)
    terms = kept.filter("term is not null").select(block.alias("block"), row.alias("row"), "lang", "source", "term", "n", nothing.cast("long").alias("terms"), nothing.cast("int").alias("place"))
    own = heads.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "*").select("block", row.alias("row"), "lang", "source", F.lit(None).cast("string").alias("term"), "n", "terms", "place")
    order = ["block", "row", "lang", F.col("term").asc_nulls_first()]
    dealt = terms.unionByName(own).repartition(4 * blocks, "block", "row").sortWithinPartitions(*order)
    found = keep(dealt.mapInPandas(_blocks(best, rows, tile), "lang string, source string, part string, item string, value long"), "partial")
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(group).alias("rank"))
    top = found.filter("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(group).alias("rank")).filter(F.col("rank") <= best)
    out = keep(pairs.unionByName(top), "divergence")
    for table in (kept, heads, found):
        drop(table)
    return out
