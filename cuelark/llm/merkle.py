"""Merkle manifests: a root over all documents, and for every document the proof that it is under it.

1. Leaves are hashed in the JVM, range-sorted by group and id, and written with their partition and
   place in it. Counts per group and partition, summed in order, say where a partition begins in
   its group: every leaf gets its coordinate without a window over a group.
2. Each partition builds the complete aligned subtrees of its own range, ``2**STEP`` leaves at a
   time, and passes on only the nodes whose parent it can't complete.
3. These ragged nodes are shuffled by the coordinate of the block above them, ``STEP`` levels a
   round, until one node a group is left; every round keeps the siblings that it saw.
4. Paths go back down the rounds to the partitions, which build their subtrees again and attach to
   each leaf the siblings from its own up to the root.

Group roots form a tree of the same kind. A level is cut into runs of two; a lone last node is
hashed alone, so level sizes halve, rounded up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, restored, solid

#: Levels that a partition, and then each round, builds before it passes nodes on.
STEP = 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "g string, n long, level int, at long, hash string, part long"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(c, F.col(f"`{c}`"))) for c in FIELDS]), 256)


class Subtree:
    """All complete nodes over the known nodes of some levels of a tree with ``n`` leaves, up to level ``top``."""

    def __init__(self, n: int, top: int):
        self.n, self.top = n, top
        self.levels: list[dict[int, str]] = [{} for _ in range(top + 1)]

    def size(self, level: int) -> int:
        return (self.n + (1 << level) - 1) >> level

    def build(self) -> None:
        for level in range(self.top):
            size, here, above = self.size(level), self.levels[level], self.levels[level + 1]
            if size == 1:
                break
            for at in here:
                if at & 1:
                    continue
                if at + 1 in here:
                    above[at >> 1] = digest(here[at] + here[at + 1])
                elif at + 1 == size:
                    above[at >> 1] = digest(here[at])
            # a right node whose left neighbour lies in another partition stays ragged

    def above(self, level: int, at: int) -> bool:
        """Whether the parent of a node is known."""
        return level < self.top and self.size(level) > 1 and (at >> 1) in self.levels[level + 1]

    def path(self, level: int, at: int) -> tuple[int, int, str]:
        """The highest known node above (level, at), and the siblings on the way, lowest first."""
        met = []
        while self.above(level, at):
            if (other := at ^ 1) in self.levels[level]:
                met.append(self.levels[level][other])
            level, at = level + 1, at >> 1
        return level, at, "".join(met)

    def ragged(self):
        for level, nodes in enumerate(self.levels):
            for at, value in nodes.items():
                if not self.above(level, at):
                    yield level, at, value


def fold(value: str, at: int, n: int, siblings: str) -> str:
    """The root of a tree of ``n`` leaves that holds ``value`` as leaf ``at`` beside these siblings."""
    used = 0
    while n > 1:
        if at & 1:
            value, used = digest(siblings[used : used + 64] + value), used + 64
        elif at + 1 < n:
            value, used = digest(value + siblings[used : used + 64]), used + 64
        else:
            value = digest(value)
        at, n = at >> 1, (n + 1) >> 1
    return value


def walk(batches, done, step: int):
    """``done(leaves, above)`` for each ``2**step`` aligned leaves of a group and partition.

    Rows come sorted by g, part, kind and at: kind 0 says what stands above a ragged node (level,
    at), kind 1 is a leaf. Not more than one chunk of leaves is held, in whatever batches it comes.
    """
    key, block, held, above = None, None, [], {}
    for b in batches:
        if not len(b):
            continue
        own = pd.DataFrame({"g": b["g"], "part": b["part"], "block": np.where(b["kind"] == 1, b["at"].to_numpy() >> step, -1)})
        cuts = [*((own != own.shift()).any(axis=1).to_numpy().nonzero()[0].tolist()), len(b)]
        for lo, hi in zip(cuts, cuts[1:]):
            *now, at = own.iloc[lo].tolist()
            if held and (now != key or at != block):
                yield done(pd.concat(held), above)
                held = []
            if now != key:
                key, above = now, {}
            block = at
            rows = b.iloc[lo:hi]
            if at < 0:
                above.update(((r.level, r.at), r) for r in rows.itertuples())
            else:
                held.append(rows)
    if held:
        yield done(pd.concat(held), above)


def _subtree(rows: pd.DataFrame, step: int) -> Subtree:
    tree = Subtree(int(rows["n"].iloc[0]), step)
    tree.levels[0] = dict(zip(rows["at"].tolist(), rows["hash"].tolist()))
    tree.build()
    return tree


def _local(step: int):
    def done(rows, _):
        tree = _subtree(rows, step)
        g, part = rows["g"].iloc[0], rows["part"].iloc[0]
        return pd.DataFrame([(g, tree.n, level, at, value, part) for level, at, value in tree.ragged()], columns=["g", "n", "level", "at", "hash", "part"])

    return lambda batches: walk(batches, done, step)


def _round(top: int):
    def run(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        tree = Subtree(int(nodes["n"].iloc[0]), top)
        for level, at, value in zip(nodes["level"].tolist(), nodes["at"].tolist(), nodes["hash"].tolist()):
            tree.levels[level][at] = value
        tree.build()
        out = []
        for level, at in zip(nodes["level"].tolist(), nodes["at"].tolist()):
            to, place, siblings = tree.path(level, at)
            out.append((to, place, tree.levels[to][place], siblings))
        return nodes.assign(**dict(zip(("to", "place", "over", "siblings"), map(list, zip(*out)))))

    return run


def indexed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves (g, hash, ...) with ``part``, ``at``, their place in the group's order, and ``n``, the group's size."""
    ordered = keep(leaves.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("row", F.monotonically_increasing_id()), "leaves")
    ordered = ordered.withColumn("part", F.shiftright("row", 33))
    counts = ordered.groupBy("g", "part").agg(F.count(F.lit(1)).alias("k"), F.min("row").alias("first"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("g", "part", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")).alias("base"), F.sum("k").over(Window.partitionBy("g")).alias("n"))
    return ordered.join(keep(offsets, "offsets").hint("merge"), ["g", "part"]).withColumn("at", F.col("row") + F.col("base")).drop("base", "row")


def climbed(rows: DataFrame, step: int = STEP) -> DataFrame:
    """(g, part, level, at, n, siblings, root): for the ragged nodes of each partition of indexed leaves, what stands above them."""
    dealt = rows.select("g", "part", "at", "n", "hash", F.lit(1).alias("kind")).repartition("g", "part").sortWithinPartitions("g", "part", "at")
    nodes = keep(dealt.mapInPandas(_local(step), NODE), "ragged")
    most = nodes.agg(F.max("n")).first()[0] or 1
    rounds, top = [], step
    while not rounds or (1 << top) < most:
        top += step
        block = F.expr(f"shiftright(at, {top} - level)")
        made = nodes.groupBy("g", block.alias("block")).applyInPandas(_round(top), NODE + ", to int, place long, over string, siblings string")
        rounds.append(keep(made, "round"))
        nodes = rounds[-1].select("g", "n", F.col("to").alias("level"), F.col("place").alias("at"), F.col("over").alias("hash"), F.lit(0).cast("long").alias("part")).distinct()
    ends = ["g", "n", "level", "at", "part", "siblings", F.col("over").alias("root")]
    higher = rounds[-1].select(*ends)
    for low in reversed(rounds[:-1]):
        over = higher.select("g", F.col("level").alias("to"), F.col("at").alias("place"), F.col("siblings").alias("more"), "root")
        higher = low.drop("over").join(over.hint("merge"), ["g", "to", "place"]).select("g", "n", "level", "at", "part", F.concat("siblings", "more").alias("siblings"), "root")
    return higher


def _paths(step: int):
    """Siblings from each leaf up to the root of its group."""

    def done(rows, above):
        tree, out = _subtree(rows, step), []
        for g, name, at, value in zip(rows["g"].tolist(), rows["name"].tolist(), rows["at"].tolist(), rows["hash"].tolist()):
            level, place, met = tree.path(0, at)
            over = above[level, place]
            out.append((name, at, tree.n, met + over.siblings, over.root))
        return pd.DataFrame(out, columns=["g", "place", "roots", "upper", "root"])

    return lambda batches: walk(batches, done, step)


def _proofs(step: int):
    def done(rows, above):
        tree, out = _subtree(rows, step), []
        for doc, at, value, forged in zip(rows["doc_id"].tolist(), rows["at"].tolist(), rows["hash"].tolist(), rows["forged"].tolist()):
            level, place, met = tree.path(0, at)
            over = above[level, place]
            mine = met + over.siblings
            folded = fold(fold(forged, at, tree.n, mine), over.place, over.roots, over.upper)
            out.append((doc, value, over.subroot, over.root, digest(mine + over.upper), folded, folded == over.root))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return lambda batches: walk(batches, done, step)


def _beside(leaves: DataFrame, heads: DataFrame) -> DataFrame:
    """Leaves behind what stands above their partition's ragged nodes, dealt and sorted for :func:`walk`."""
    rows = heads.withColumn("kind", F.lit(0)).unionByName(leaves.withColumn("kind", F.lit(1)).withColumn("level", F.lit(-1)), allowMissingColumns=True)
    # Arrow turns whole numbers beside nulls into floats
    filled = [F.coalesce(c, F.lit(0).cast(t)).alias(c) if t in ("bigint", "int") else F.col(c) for c, t in rows.dtypes]
    return rows.select(*filled).repartition("g", "part").sortWithinPartitions("g", "part", "kind", "at")


def manifest(docs: DataFrame, step: int = STEP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of documents.

    A leaf covers doc_id, source, lang, n_chars and text; nulls differ from empty strings. Rows
    are ordered in their language by doc_id (null first), then by leaf, so that rows that repeat
    an id have a place each; equal rows have equal leaves and different proofs. Where 7 divides
    the crc32 of the id, the row that is verified had 1 added to n_chars; a null id or n_chars
    leaves it as it is. An empty table has no rows and no root. Further columns are ignored.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(tampered & F.col("n_chars").isNotNull(), leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))
    g = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), "lang"))
    hashed = docs.select(g.alias("g"), solid("doc_id").alias("doc_id"), leaf().alias("hash"), changed.alias("forged"))
    rows = indexed(hashed.withColumn("forged", F.coalesce("forged", "hash")), ["doc_id", "hash"])
    higher = keep(climbed(rows, step).withColumnRenamed("root", "subroot"), "higher")
    roots = indexed(higher.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("subroot").alias("hash")).distinct(), ["name"])
    tops = _beside(roots, climbed(roots, step)).mapInPandas(_paths(step), "g string, place long, roots long, upper string, root string")
    heads = higher.join(keep(tops, "tops"), "g")
    made = _beside(rows, heads).mapInPandas(_proofs(step), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return made.withColumn("doc_id", restored("doc_id"))
