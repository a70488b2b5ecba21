"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep


def forest(pairs) -> list[tuple[int, int]]:
    """The pairs that join two trees not joined before; at most one fewer than there are nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _stars(batches):
    """Edges of each batch as stars around the smallest node that the batch reaches."""
    for b in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for u, v in zip(b["a"].tolist(), b["b"].tolist()):
            x, y = find(u), find(v)
            if x != y:
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        tops = [find(x) for x in nodes]
        out = pd.DataFrame({"a": np.array(nodes, "int64"), "b": np.array(tops, "int64")})
        yield out[out.a != out.b]


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b); component is the smallest id reachable.

    Each round is a minimum per node and a join on that node; every edge list is written to the
    shared folder. Batches are first shrunk to stars where they lie. Rows with a null are ignored.
    """
    now = keep(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInPandas(_stars, "a long, b long").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every edge points from the larger node to the smaller
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        before, now = now, keep(
            down.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges"
        )
        drop(before)
        was, mark = mark, now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("b", "a") % 1_000_003))).first()
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
