"""Near-duplicate texts by an LSH forest over MinHash signatures.

1. Every whole text becomes a set of word shingles and a signature. Texts with equal sets form a
   class; only the smallest id of a class goes on.
2. A class appears once in each of several trees: an order of its signature values. Each tree's
   rows are sorted by their first ``DEPTH`` values and the next ones, over ranges of the order, so
   a region (rows that share the first values) of any size spreads over tasks. Neighbours in the
   order are those with the longest common prefix: deep where a region is dense, shallow where it
   is sparse. A row meets the ``WINDOW`` rows before it in its region, also across the border of
   two tasks; those whose two-bit sketches agree enough are candidates.
3. Candidates are confirmed on full sets of shingle hashes, in rounds. In the first rounds each
   class asks its most alike candidate of all trees. Its component then goes back into the trees
   of the classes that have further candidates, so that only pairs between components, not asked
   before, come out again. In the last round the sets travel in the trees as well, once a tree,
   and all pairs that are still open are compared where they meet; only links come out. No
   candidate is left out but those whose ends are joined already.
4. Components of the confirmed links are the near-duplicate groups.

Two sets of similarity 0.8 share the first four values of a tree with probability 0.41, so all
20 trees miss them with probability 3e-5, more similar ones less; the sketch misses one pair in
20,000. In a region above ``WINDOW`` rows a pair also needs a long common prefix in one tree; the
tests measure the recall there against brute force.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, drop, keep, restored, solid
from .components import components

TREES, DEPTH, VALUES, DEEPER = 20, 4, 128, 8
#: Rows before each row in a region's order that it meets.
WINDOW = 128
#: Of 128 two-bit values so many may differ: 19 are expected at similarity 0.8, deviation 4.
MOST_APART = 35
#: Rounds in which each class asks one candidate, before the round that asks all that are still open.
PICKS = 2
_RANDOM = np.random.RandomState(20_241)
_ADD = _RANDOM.randint(0, 2**63, VALUES).astype("uint64") * np.uint64(2) + np.uint64(1)
_MUL = _RANDOM.randint(0, 2**63, VALUES).astype("uint64") * np.uint64(2) + np.uint64(1)
_OWN = np.arange(TREES * DEPTH).reshape(TREES, DEPTH)
_NEXT = np.stack([_RANDOM.permutation(np.setdiff1d(np.arange(VALUES), own))[:DEEPER] for own in _OWN])
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z in lower case, words split at ASCII white space."""
    if not text:
        return np.zeros(0, "uint64")
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 1)], "uint64") if parts else np.zeros(0, "uint64")
    if len(known) > 1_000_000:
        known.clear()
    h = np.fromiter(map(known.__getitem__, parts), "uint64", len(parts))
    n = len(h) - words + 1
    out = h[:n].copy()
    for i in range(1, words):
        out = _mix(out) * _STEP + h[i : i + n]
    return np.unique(_mix(out))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values [set, value] of sets that aren't empty."""
    out = np.empty((len(sets), VALUES), "uint32")
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= 32_768):
            n += len(sets[to])
            to += 1
        whole = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *map(len, sets[at : to - 1])])
        for j in range(VALUES):
            out[at:to, j] = np.minimum.reduceat((whole ^ _ADD[j]) * _MUL[j], starts) >> np.uint64(32)
        at = to
    return out


def _features(words: int):
    def run(batches):
        known = _Hashes()
        for b in batches:
            sets = [shingles(x, words, known) for x in b["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = signatures([sets[i] for i in full]) if full else ()
            sig: list = [None] * len(sets)
            for i, row in zip(full, rows):
                sig[i] = row.tobytes()
            yield pd.DataFrame({"id": b["id"], "n_shingles": [len(s) for s in sets], "class": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "sig": sig})

    return run


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "uint32").reshape(-1, VALUES)


def _keys(sig: np.ndarray) -> np.ndarray:
    """Region keys [set, tree]."""
    own = sig[:, _OWN].astype("uint64")
    out = np.arange(1, TREES + 1, dtype="uint64")[None, :] * _STEP
    for i in range(DEPTH):
        out = _mix(out + own[:, :, i] * _STEP)
    return out.view("int64")


def _trees(names: list[str]):
    """A row a tree: region key, next values packed in order, id, the sketch, and the columns that earlier rounds found. One tree at a time, so that a batch of sets is never held twice."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            sig = _sigs(b["sig"])
            keys = _keys(sig)
            bits = (sig & np.uint32(3)).astype("uint64").reshape(-1, 4, 32)
            sketch = (bits << (np.arange(32, dtype="uint64") * np.uint64(2))).sum(2, dtype="uint64").view("int64")
            fixed = {f"k{i}": sketch[:, i] for i in range(4)}
            for tree in range(TREES):
                deep = (sig[:, _NEXT[tree]] & np.uint32(0xFFFF)).astype("uint64")
                s1, s2 = (sum(deep[:, 4 * h + i] << np.uint64(48 - 16 * i) for i in range(4)).view("int64") for h in (0, 1))
                new = {"region": keys[:, tree], "s1": s1, "s2": s2, **fixed}
                yield pd.DataFrame({c: new[c] if c in new else b[c] for c in names})

    return run


_SKETCH = [f"k{i}" for i in range(4)]
_ORDER = ["region", "s1", "s2", "id"]
#: A class's component and the candidates that it has asked; its own id and none at first.
_KNOWN = ["component", *(f"asked{i}" for i in range(PICKS))]
_NAMES = [*_ORDER, *_SKETCH, *_KNOWN]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many two-bit values of two sketches differ, row by row."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1, dtype="int64")


def _pairs(rows: pd.DataFrame, fresh: int, picks: bool, percent: int | None = None) -> pd.DataFrame:
    """Open candidates (a, b, apart) among sorted rows, of which those from ``fresh`` on are new.

    With ``picks`` the most alike one of each new row a, and (a, a, -1) for every row of a pair
    that was not picked; else all pairs, a above b, or of these the linked ones with ``percent``.
    """
    region, ids = rows["region"].to_numpy(), rows["id"].to_numpy()
    sketch = rows[_SKETCH].to_numpy("int64").view("uint64")
    known = rows[_KNOWN].to_numpy("int64")
    x, y, apart = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    later = np.arange(max(1, fresh), len(rows))
    for back in range(1, WINDOW + 1):
        later = later[later >= back]
        later = later[region[later] == region[later - back]]
        if not len(later):
            break
        other = later - back
        d = _apart(sketch[later], sketch[other])
        near = (d <= MOST_APART) & (known[later, 0] != known[other, 0])
        for i in range(1, 1 + PICKS):
            near &= (known[later, i] != ids[other]) & (known[other, i] != ids[later])
        x.append(later[near])
        y.append(other[near])
        apart.append(d[near])
    x, y, apart = np.concatenate(x), np.concatenate(y), np.concatenate(apart)
    if picks:
        by = np.lexsort((ids[y], apart, x))
        x, y, apart = x[by], y[by], apart[by]
        best = np.r_[True, x[1:] != x[:-1]][: len(x)]
        more = np.unique(np.concatenate([ids[x[~best]], ids[y[~best]]]))
        return pd.DataFrame({"a": np.r_[ids[x[best]], more], "b": np.r_[ids[y[best]], more], "apart": np.r_[apart[best], np.full(len(more), -1)]})
    if percent:
        sets = [np.frombuffer(one, "uint64") for one in rows["set"]]
        linked = np.fromiter((_linked(sets[i], sets[j], percent) for i, j in zip(x.tolist(), y.tolist())), bool, len(x))
        x, y, apart = x[linked], y[linked], apart[linked]
    return pd.DataFrame({"a": np.maximum(ids[x], ids[y]), "b": np.minimum(ids[x], ids[y]), "apart": apart})


def _neighbours(borders: bool, most: int = 8_000, picks: bool = False, percent: int | None = None):
    """Candidates (a, b, apart) of sorted rows; with ``borders`` also the rows (a null) at either end of the task that later rows of their region may have to meet."""

    def run(batches):
        held, size, carried, count, first = [], 0, None, 0, None
        names = [*_NAMES, *["set"] * bool(percent)]

        def step():
            nonlocal carried, count, first
            new = pd.concat(held, ignore_index=True)
            rows = new if carried is None else pd.concat([carried, new], ignore_index=True)
            fresh = len(rows) - len(new)
            out = _pairs(rows, fresh, picks, percent)
            if borders and len(new):
                first = new["region"].iloc[0] if first is None else first
                head = new.iloc[: max(0, WINDOW - count)]
                out = pd.concat([out, head[head["region"] == first]], ignore_index=True)
            count += len(new)
            carried = rows.iloc[-WINDOW:]
            return out

        def shaped(out):
            out = out.reindex(columns=["a", "b", "apart", *names])
            return out.astype({c: "object" if c == "set" else "Int64" for c in out.columns})

        for b in batches:
            held.append(b)
            size += len(b) + (int(b["set"].str.len().sum()) // 4096 if percent else 0)
            if size >= most:
                yield shaped(step())
                held, size = [], 0
        if size:
            yield shaped(step())
        if borders and carried is not None:
            tail = carried.iloc[max(0, len(carried) - max(0, count - WINDOW)) :]  # rows that were no head
            tail = pd.concat([carried.iloc[: len(carried) - len(tail)].loc[lambda r: r["region"] != first], tail])
            yield shaped(tail[tail["region"] == carried["region"].iloc[-1]])

    return run


def candidates(classes: DataFrame, picks: bool = False, percent: int | None = None) -> DataFrame:
    """(a, b, apart), each pair once, of classes (id, sig, with ``percent`` set, and what is known of them): neighbours in a tree whose sketches agree; see ``_pairs``."""
    fresh = {"component": F.col("id"), **{c: F.lit(NO_ID) for c in _KNOWN[1:]}}
    names = [*_NAMES, *["set"] * bool(percent)]
    classes = classes.select("id", "sig", *names[len(_NAMES) :], *[F.coalesce(c, fresh[c]).alias(c) if c in classes.columns else fresh[c].alias(c) for c in _KNOWN])
    row = ", ".join(f"{c} {'binary' if c == 'set' else 'long'}" for c in names)
    shape = f"a long, b long, apart long, {row}"
    rows = classes.mapInPandas(_trees(names), row)
    near = keep(rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInPandas(_neighbours(True, picks=picks, percent=percent), shape), "near")
    # at most 2 * WINDOW rows of each task
    edge = near.filter("a is null").select(*names).repartition("region").sortWithinPartitions(*_ORDER)
    across = edge.mapInPandas(_neighbours(False, picks=picks, percent=percent), shape)
    found = keep(near.filter("a is not null").unionByName(across).groupBy("a", "b").agg(F.min("apart").alias("apart")), "candidates")
    drop(near)
    return found


def _sets(words: int):
    def run(batches):
        known = _Hashes()
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "set": [shingles(x, words, known).tobytes() for x in b["text"]]})

    return run


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    both = np.sort(np.concatenate([one, two]), kind="stable")
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(one) + len(two) - same)


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            linked = [_linked(np.frombuffer(one, "uint64"), np.frombuffer(two, "uint64"), percent) for one, two in zip(b["one"], b["two"])]
            yield b.loc[linked, ["a", "b"]]

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets (id, set) are linked."""
    # merge joins whatever the sizes: they may spill, and the plan is the same for any input
    one, two = (sets.select(F.col("id").alias(end), F.col("set").alias(name)).hint("merge") for end, name in (("a", "one"), ("b", "two")))
    asked = pairs.select("a", "b").join(one, "a").join(two, "b")
    return keep(asked.select("a", "b", "one", "two").mapInPandas(_confirm(percent), "a long, b long"), "links")


def joined(classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component) of the classes (id, sig) that are linked with another one; texts are (id, text).

    Every candidate pair is either confirmed or refuted on full sets, or its ends are joined already.
    """
    sets, links, asked = None, None, []
    for turn in range(PICKS):
        found = candidates(classes, picks=True)
        first = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
        ranked = found.filter("apart >= 0").withColumn("place", first)
        pairs = keep(ranked.filter("place = 1").select("a", "b"), "asked")
        rest = ranked.filter("place > 1")
        open_ = keep(rest.select(F.col("a").alias("id")).union(rest.select("b")).union(found.filter("apart < 0").select("a")).distinct(), "open")
        asked.append(pairs)
        if sets is None:  # later rounds ask classes of the first one only
            members = keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(open_).distinct(), "members")
            sets = keep(texts.join(members.hint("merge"), "id", "left_semi").mapInPandas(_sets(words), "id long, set binary").distinct(), "sets")
        more = confirm(pairs, sets, percent)
        links = more if links is None else links.unionByName(more)
        drop(found)
        groups = components(links)
        if not open_.take(1):
            break
        classes = classes.select("id", "sig").join(open_, "id", "left_semi").join(groups, "id", "left")
        for i, before in enumerate(asked):
            classes = classes.join(before.select(F.col("a").alias("id"), F.col("b").alias(f"asked{i}")), "id", "left")
        classes = keep(classes, "classes")
    else:
        last = candidates(classes.join(sets.hint("merge"), "id"), percent=percent)
        groups = components(links.unionByName(last.select("a", "b")))
    drop(sets)
    return groups


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Texts are linked when 100 * |intersection| >= ``percent`` * |union| of their sets of distinct
    ``words``-word shingles; a text of fewer words has its whole sequence as its one shingle.
    Empty, blank and null texts have no shingles and link with nothing. component_id is the
    smallest doc_id reachable by links, itself included; kept marks the row with that id. Rows
    that repeat an id are judged by their own text each. A null id is in no component but its own
    (null), and never kept nor a reason to drop another row.
    """
    source = docs.select(solid(doc_id).alias("id"), F.col(text).alias("text"))
    features = keep(source.mapInPandas(_features(words), "id long, n_shingles long, class binary, sig binary"), "features")
    named = features.filter(F.col("class").isNotNull() & (F.col("id") != NO_ID))
    least = keep(named.groupBy("class").agg(F.min("id").alias("first")), "classes")
    classes = keep(features.join(least.withColumnRenamed("first", "id"), ["class", "id"], "left_semi").select("id", "sig"), "first")
    groups = joined(classes, source.filter("text is not null"), words, percent)
    rows = features.select("id", "n_shingles", "class").join(least, "class", "left").join(groups.withColumnRenamed("id", "first"), "first", "left")
    own = restored("id")
    component = F.when(own.isNotNull(), F.coalesce("component", "first", "id"))
    return rows.select(own.alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(own == component, F.lit(False)).alias("kept"))
