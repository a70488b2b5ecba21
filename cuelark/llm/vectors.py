"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors of cosine c lie sqrt(2 - 2c) apart, and no further apart on any direction. Vectors
are sorted by the grid cells (of that width) of their leading principal directions and cut into
blocks; two blocks meet only if the boxes around their leading coordinates are near. Inside a
meeting both sequences are halved again and again, distant halves are skipped, and what is left
is compared in double precision. Equal vectors of one label form a class beforehand, so copies
cost nothing; a meeting emits counts and a forest of links, never all pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, restored, solid
from .components import components, forest

#: Leading directions in the grid and in the boxes; vectors a block; wider vectors are turned onto so many random directions first.
GRID, BOX, BLOCK, WIDEST = 3, 8, 512, 256
LEAF = 64


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid(batches):
    """Usable vectors as bytes: (vec_id, label, size, class, raw)."""
    for b in batches:
        out = []
        for vec, label, v in zip(b["vec_id"], b["label"], b["embedding"]):
            if v is None or label is None or pd.isna(label) or not len(v):
                continue
            x = np.array(v, "float64")
            if np.isfinite(x).all() and x.any():
                narrow = x.astype("float32")
                raw = narrow.tobytes() if (narrow == x).all() else x.tobytes()
                out.append((vec, str(label), len(x), xxhash.xxh3_128_digest(x.tobytes()), raw))
        yield pd.DataFrame(out, columns=["vec_id", "label", "size", "class", "raw"])


def _read(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, "float32" if len(raw) == 4 * size else "float64").astype("float64")


@lru_cache(maxsize=8)
def _turn(size: int, width: int) -> np.ndarray:
    """Orthonormal directions over all ``size`` coordinates: distances along them are never longer than the true ones."""
    return np.linalg.qr(np.random.RandomState(size).randn(size, width))[0]


def _narrow(raw: bytes, size: int, width: int) -> np.ndarray:
    """The unit vector in ``width`` coordinates: itself, or its shadow if it is wider."""
    u = _unit(_read(raw, size)[None])[0]
    return u if size <= width else u @ _turn(size, width)


def _moments(width: int):
    """Sums of coordinates and of their products over a task; a row a number."""

    def run(batches):
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            x = np.zeros((len(b), width + 1))
            for row, raw, size in zip(x, b["raw"], b["size"]):
                u = _narrow(raw, size, width)
                row[: len(u)], row[width] = u, 1
            total += x.T @ x
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    return run


def directions(classes: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal directions over all vectors; the driver gets width * width numbers."""
    total = np.zeros((width + 1) ** 2)
    for r in classes.select("raw", "size").mapInPandas(_moments(width), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r["at"]] = r["v"]
    total = total.reshape(width + 1, width + 1)
    n = max(1.0, total[width, width])
    mean = total[width, :width] / n
    _, vectors = np.linalg.eigh(total[:width, :width] / n - np.outer(mean, mean))
    return mean, vectors[:, ::-1][:, : min(BOX, width)]


def _place(shared, epsilon: float):
    def run(batches):
        mean, lead = shared.value
        for b in batches:
            at = np.zeros((len(b), lead.shape[1]))
            for i, (raw, size) in enumerate(zip(b["raw"], b["size"])):
                u = np.zeros(len(mean))
                own = _narrow(raw, size, len(mean))
                u[: len(own)] = own
                at[i] = (u - mean) @ lead
            cells = np.floor(at[:, :GRID] / epsilon).astype("int64")
            cells = np.pad(cells, ((0, 0), (0, GRID - cells.shape[1])))
            yield b.assign(**{f"c{i}": cells[:, i] for i in range(GRID)}, at=[x.tobytes() for x in at])

    return run


def _blocks(epsilon: float):
    """Sorted rows cut into blocks of one label and size each."""

    def run(batches):
        task, no, rows, now = TaskContext.get().partitionId(), 0, [], None

        def block():
            nonlocal no
            at = np.frombuffer(b"".join(r[3] for r in rows), "float64").reshape(len(rows), -1)
            lo, hi = at.min(0), at.max(0)
            no += 1
            return (
                (task << 32) + no, *now, len(rows), lo.tolist(), hi.tolist(), int(np.floor(lo[0] / epsilon)), int(np.floor(hi[0] / epsilon)),
                np.array([r[0] for r in rows], "int64").tobytes(), np.array([r[1] for r in rows], "int64").tobytes(), np.array([_read(r[2], now[1]) for r in rows]).astype("float32").tobytes() if all(len(r[2]) == 4 * now[1] for r in rows) else np.array([_read(r[2], now[1]) for r in rows]).tobytes(), at.tobytes(),
            )

        for b in batches:
            out = []
            for label, size, one, copies, raw, at in zip(b["label"], b["size"], b["id"], b["copies"], b["raw"], b["at"]):
                if rows and ((label, size) != now or len(rows) == BLOCK):
                    out.append(block())
                    rows = []
                now = (label, size)
                rows.append((one, copies, raw, at))
            yield pd.DataFrame(out, columns=_COLUMNS)
        yield pd.DataFrame([block()] if rows else [], columns=_COLUMNS)

    return run


_COLUMNS = ["block", "label", "size", "n", "lo", "hi", "c_lo", "c_hi", "ids", "copies", "raw", "at"]
_SHAPE = "block long, label string, size int, n int, lo array<double>, hi array<double>, c_lo long, c_hi long, ids binary, copies binary, raw binary, at binary"


def meetings(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(x, y) of blocks of one label and size whose boxes are within ``epsilon`` on every leading direction."""
    meta = blocks.select("block", "label", "size", "lo", "hi", "c_lo", "c_hi")
    left = meta.select("label", "size", F.col("block").alias("x"), F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi"), F.explode(F.sequence("c_lo", "c_hi")).alias("cell"))
    right = meta.select("label", "size", F.col("block").alias("y"), F.col("lo").alias("y_lo"), F.col("hi").alias("y_hi"), F.explode(F.sequence(F.col("c_lo") - 1, F.col("c_hi") + 1)).alias("cell"))
    gap = F.transform(F.arrays_zip("x_lo", "x_hi", "y_lo", "y_hi"), lambda z: F.greatest(z["x_lo"] - z["y_hi"], z["y_lo"] - z["x_hi"]))
    return left.join(right, ["label", "size", "cell"]).filter("x <= y").filter(F.array_max(gap) <= epsilon).select("x", "y").distinct()


def _meet(least: float, epsilon: float):
    def load(ids, copies, raw, at, size):
        n = len(ids) // 8
        return np.frombuffer(ids, "int64"), np.frombuffer(copies, "int64"), _unit(_read(raw, size * n).reshape(n, size)), np.frombuffer(at, "float64").reshape(n, -1)

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                left = load(r.ids, r.copies, r.raw, r.at, r.size)
                right = left if r.x == r.y else load(r.ids_y, r.copies_y, r.raw_y, r.at_y, r.size)
                count_x, count_y = np.zeros(len(left[0]), "int64"), np.zeros(len(right[0]), "int64")
                links: list[tuple[int, int]] = []

                def join(a, a_to, c, c_to):
                    if r.x == r.y and c_to <= a:
                        return
                    p, q = left[3][a:a_to], right[3][c:c_to]
                    if np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)).max() > epsilon:
                        return
                    if max(a_to - a, c_to - c) > LEAF:
                        for s, t in ((a, (a + a_to) // 2), ((a + a_to) // 2, a_to)):
                            for u, v in ((c, (c + c_to) // 2), ((c + c_to) // 2, c_to)):
                                if s < t and u < v:
                                    join(s, t, u, v)
                        return
                    near = left[2][a:a_to] @ right[2][c:c_to].T >= least
                    if r.x == r.y:
                        near &= np.arange(a, a_to)[:, None] < np.arange(c, c_to)[None, :]
                    if near.any():
                        count_x[a:a_to] += near @ right[1][c:c_to]
                        count_y[c:c_to] += left[1][a:a_to] @ near
                        s, t = np.nonzero(near)
                        links.extend(forest(zip(left[0][a + s].tolist(), right[0][c + t].tolist())))

                join(0, len(left[0]), 0, len(right[0]))
                out = [(i, 0, n) for i, n in zip(left[0].tolist(), count_x.tolist()) if n]
                out += [(i, 0, n) for i, n in zip(right[0].tolist(), count_y.tolist()) if n]
                out += [(i, j, 0) for i, j in forest(links)]
                if out:
                    yield pd.DataFrame(out, columns=["a", "b", "n"]).astype("int64")

    return run


def near_vectors(rows: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Only vectors of equal, non-null label and equal length are compared. A vector that is null,
    empty, all zero or holds a null or a number that isn't finite links with nothing. n_links
    counts other rows linked directly; component_id is the smallest vec_id reachable, itself
    included. Rows that repeat an id count as rows. A null id has a null component and isn't kept;
    such rows count in the links of others. Ids lie below 2^62: larger numbers stand for values that
    no row with an id has.
    """
    epsilon = float(np.sqrt(2 - 2 * least)) + 1e-9
    source = rows.select(solid("vec_id").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = keep(source.mapInPandas(_valid, "vec_id long, label string, size int, class binary, raw binary"), "usable")
    stand_in = F.lit(2**62).cast("long") + F.xxhash64("label", "size", "class").bitwiseAND(F.lit(2**61 - 1))
    per_class = usable.groupBy("label", "size", "class").agg(F.min(restored("vec_id")).alias("id"), F.count(F.lit(1)).alias("copies"), F.min("raw").alias("raw"))
    firsts = per_class.withColumn("id", F.coalesce("id", stand_in))
    firsts = keep(firsts, "firsts")
    width = min(WIDEST, firsts.agg(F.max("size")).first()[0] or 1)
    shared = rows.sparkSession.sparkContext.broadcast(directions(firsts, width))
    cells = ", ".join(f"c{i} long" for i in range(GRID))
    placed = firsts.select("label", "size", "id", "copies", "raw").mapInPandas(_place(shared, epsilon), f"label string, size int, id long, copies long, raw binary, {cells}, at binary")
    order = ["label", "size", *(f"c{i}" for i in range(GRID)), "id"]
    blocks = keep(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_blocks(epsilon), _SHAPE), "blocks")
    left = blocks.select(F.col("block").alias("x"), "size", "ids", "copies", "raw", "at")
    right = blocks.select(F.col("block").alias("y"), *[F.col(c).alias(f"{c}_y") for c in ("ids", "copies", "raw", "at")])
    met = keep(meetings(blocks, epsilon).join(left, "x").join(right, "y").mapInPandas(_meet(least, epsilon), "a long, b long, n long"), "met")
    counts = met.filter("n > 0").groupBy("a").agg(F.sum("n").alias("others"))
    groups = components(met.filter("n = 0").select("a", "b"))
    known = firsts.select("label", "size", "class", "id", "copies").join(counts.withColumnRenamed("a", "id"), "id", "left").join(groups, "id", "left")
    found = usable.join(known.select("label", "size", "class", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("group")), ["label", "size", "class"])
    lone = source.mapInPandas(_unusable, "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("group"))
    own = restored("vec_id")
    every = found.select("vec_id", "n_links", "group").unionByName(lone)
    return every.select(own.alias("vec_id"), "n_links", F.when(own.isNotNull(), F.col("group")).alias("component_id"), F.coalesce(own == F.col("group"), F.lit(False)).alias("kept"))


def _unusable(batches):
    for b in batches:
        good = next(_valid(iter([b.assign(vec_id=np.arange(len(b)))])))["vec_id"].to_numpy("int64")
        yield b.drop(index=b.index[good])[["vec_id"]]
