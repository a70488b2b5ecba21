"""Document fingerprints by winnowing.

The units of a text are runs of up to ``PART`` characters of its words, so that tiny texts and texts
without spaces have units as well. Every unit ends one gram: it and the ``GRAM`` - 1 units before
it, with marks in front of the first. A gram's hash is rolled: the hash of 2n units is that of the
first n, rotated by n, xor that of the last n, so no unit is hashed twice. Of each window of
``WINDOW`` grams, the shorter ones at the beginning included, the smallest hash is chosen, the
rightmost of equal ones. The chosen hashes and their positions (in units) are the fingerprint.

One rule holds at every length. A passage of GRAM + WINDOW - 1 units that two texts share puts at
least one common hash into both fingerprints, and so does a common beginning of one unit.
Everything here is a DataFrame expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import restored, solid

#: Characters a unit, units a gram and grams a window; the last two are powers of two.
PART, GRAM, WINDOW = 6, 4, 8
#: Positions take the low bits of a key, so that the smallest key is the smallest hash at its rightmost place.
_LAST = 2**31 - 1
_MOST = 2**63 - 1
#: Sampled rows a range, from which the ranges' borders are taken.
SAMPLE = 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _doubled(values: Column, to: int, join: Callable[[Column, Column, int], Column]) -> Column:
    """Joins each value with those after it, 1, 2, 4, ... further on, until each stands for ``to`` of them."""

    def step(n: int) -> Callable[[Column], Column]:
        return lambda v: F.transform(v, lambda x, i: join(x, F.get(v, i + n), n))

    n = 1
    while n < to:
        values, n = let(values, step(n)), 2 * n
    return values


def grams(text: Column, gram: int = GRAM, part: int = PART) -> Column:
    """Hashes of the grams that end at each unit of a text."""
    units = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % part), F.lit(0))
    marked = let(F.transform(units, lambda w: F.xxhash64(w)), lambda h: F.concat(F.array_repeat(F.lit(1).cast("long"), gram - 1), h))
    roll = lambda a, b, n: F.shiftleft(a, n).bitwiseOR(F.shiftrightunsigned(a, 64 - n)).bitwiseXOR(b)
    return F.filter(_doubled(marked, gram, roll), lambda x: x.isNotNull())


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW, part: int = PART) -> Column:
    """array<struct<hash, position>> in order of position; empty for a text without words."""

    def chosen(hashes: Column) -> Column:
        keys = F.transform(hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 33), 31).bitwiseOR(F.lit(_LAST) - i))
        padded = F.concat(F.array_repeat(F.lit(_MOST), window - 1), keys)
        least = _doubled(padded, window, lambda a, b, n: F.least(a, b))
        places = F.transform(F.array_distinct(F.slice(least, F.lit(1), F.size(hashes))), lambda k: (F.lit(_LAST) - k.bitwiseAND(F.lit(_LAST))).cast("int"))
        return F.transform(places, lambda p: F.struct(F.get(hashes, p).alias("hash"), p.alias("position")))

    return let(grams(text, gram, part), chosen)


def hashes(print_: Column) -> Column:
    return F.array_distinct(F.transform(print_, lambda p: p["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct hashes; two empty ones are alike."""
    same = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(same, lambda s: s / F.greatest(F.size(a) + F.size(b) - s, F.lit(1)))).cast("double")


def spelled(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda p: F.concat_ws("@", F.lower(F.hex(p["hash"])), p["position"])), " ")


def _range(cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted cuts aren't above (place, mark): a search in two steps, so that many cuts cost few comparisons a row."""
    wide = max(1, math.isqrt(len(cuts)))
    row = F.struct("place", "mark")
    pair = lambda c: F.struct(F.lit(c[0]).cast("long").alias("place"), F.lit(c[1]).cast("long").alias("mark"))
    below = lambda some: F.size(F.filter(some, lambda c: c <= row))
    if not cuts:
        return F.lit(0)
    heads = F.array(*[pair(c) for c in cuts[::wide]])
    parts = F.array(*[F.array(*[pair(c) for c in cuts[i : i + wide]]) for i in range(0, len(cuts), wide)])
    return let(below(heads), lambda n: F.when(n == 0, 0).otherwise((n - 1) * wide + below(F.get(parts, n - 1))))


def with_next(rows: DataFrame, carried: list[str], tasks: int, derive: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Each row of (place, mark, text, ...) with ``carried`` columns (as struct ``next``) of the row that follows by place, mark and text; after the last comes the first.

    Rows are dealt into ranges of (place, mark) whose borders come from a sample of ``SAMPLE`` rows
    a range; rows of one place spread over ranges by mark. The first row of each range also goes,
    as a guest, to the end of the range before, so a window over one range finds every neighbour.
    ``derive`` adds columns after the rows have been dealt, so these needn't cross the exchange.
    """
    share = min(1.0, SAMPLE * tasks / max(1, rows.count()))
    some = sorted((r["place"], r["mark"]) for r in rows.select("place", "mark").sample(share, 11).collect())
    cuts = sorted({some[len(some) * i // tasks] for i in range(1, tasks)}) if some else []
    own = rows.withColumn("range", _range(cuts)).withColumn("guest", F.lit(False))
    # a row a range, whatever the input
    heads = sorted((r["range"], *r["head"]) for r in own.groupBy("range").agg(F.min(F.struct("place", "mark")).alias("head")).collect())
    table = [(place, mark, heads[i - 1][0]) for i, (_, place, mark) in enumerate(heads)]
    table = F.broadcast(rows.sparkSession.createDataFrame(table, "place long, mark long, range int"))
    guests = rows.join(table, ["place", "mark"]).withColumn("guest", F.lit(True))
    order = Window.partitionBy("range").orderBy("guest", "place", "mark", "text")
    dealt = derive(own.unionByName(guests).repartitionByRange(max(1, tasks), "range"))
    return dealt.withColumn("next", F.lead(F.struct(*carried)).over(order)).filter(~F.col("guest")).drop("range", "guest")


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row and of its edited text, and their likeness.

    The edited text ends in the first floor(n_chars / 2) code points of the next row (by
    descending doc_id, null ids last, equal ids by hash and text; after the last row comes the
    first) instead of its own last as many. A null text is empty. A row alone in its table follows itself.
    """
    spark = docs.sparkSession
    source = docs.select(solid(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.select(F.bitwise_not("doc_id").alias("place"), F.xxhash64("text").alias("mark"), "doc_id", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    derive = lambda rows: rows.withColumn("print", fingerprint(F.col("text"))).withColumn("own", hashes(F.col("print")))
    paired = with_next(source, ["text", "own"], tasks, derive)
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substr("next.text", F.lit(1), F.floor(n / 2).cast("int")))
    made = paired.select("doc_id", n.cast("long").alias("n_chars"), "print", "own", F.col("next.own").alias("next_own"), edited.alias("edited"))
    made = made.select("*", fingerprint(F.col("edited")).alias("edited_print"))
    return made.select(
        restored("doc_id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("print")).alias("fingerprint"),
        spelled(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("edited_print"))).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
