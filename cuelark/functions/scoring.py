"""Scoring of recognized text against a reference: tokens by Unicode rules, edit distances, rates."""

from __future__ import annotations

import operator
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Arabic letters written as their Persian forms, and the half-space.
PERSIAN = str.maketrans({"ي": "ی", "ك": "ک", "‌": " "})
_TOKEN = re.compile(r"[^\W_]+")
#: Rows of a batch that are Python objects at one time, and bytes of their texts, unless one text alone has more.
_ROWS, _BYTES = 256, 1 << 20


class _Plain(dict):
    """What stands for a character: nothing for marks, 0-9 for digits."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = None if unicodedata.category(c) == "Mn" else str(unicodedata.digit(c)) if c.isdigit() else c
        return self[code]


_PLAIN = _Plain()


def _folded(text: str | None) -> str:
    if not text or text.isascii():
        return (text or "").lower()
    return unicodedata.normalize("NFKC", text).casefold().translate(PERSIAN).replace("ـ", "").translate(_PLAIN)


def tokens_of(text: str | None) -> list[str]:
    """Letters and digits, compatibility forms folded, case folded, marks and tatweel dropped, digits as 0-9."""
    return _TOKEN.findall(_folded(text))


def count_of(text: str | None) -> int:
    """How many tokens a text has; they are never all there at one time."""
    return sum(1 for _ in _TOKEN.finditer(_folded(text)))


def units_of(text: str | None, language: str | None) -> list[str]:
    """Words, or characters for Japanese; only letters, numbers and white space count."""
    low = unicodedata.normalize("NFKC", text or "").lower()
    if language == "fa":
        low = low.translate(PERSIAN)
    kept = "".join(c if c.isspace() or unicodedata.category(c)[0] in "LN" else " " for c in low)
    return list("".join(kept.split())) if language == "ja" else kept.split()


def _columns(a: list, b: list):
    """Least edits between all prefixes of ``a`` and each prefix of ``b``, as differences: whole columns in
    the bits of three numbers (Myers 1999, Hyyrö 2003). ``up`` and ``down``: one more or less than with a
    token of ``a`` less; ``same``: as many as with a token of both less."""
    at: dict = {}
    for i, token in enumerate(a):
        at[token] = at.get(token, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down = full, 0
    for token in b:
        equal = at.get(token, 0)
        same = (((equal & up) + up ^ up) | equal | down) & full
        right = ((down | (same | up) ^ full) << 1 | 1) & full
        up, down = ((same & up) << 1 | (same | right) ^ full) & full, right & same
        yield up, down, same


def _near(a: list, b: list, most: int) -> int | None:
    """Least token edits if they are at most ``most``, else None. Of each column only the ``most`` cells on either
    side of the diagonal are kept, in the bits of two numbers that move down with it (Hyyrö 2003, diagonal tiling).
    ``a`` is the longer, and ``most`` at least the difference of the lengths and at most the length of ``a``."""
    at: dict = {}
    for i, token in enumerate(a, most):
        at[token] = at.get(token, 0) | 1 << i
    full, last = (1 << 2 * most + 1) - 1, 1 << 2 * most
    up, down, found, turn = full >> most << most, 0, most, len(a) - most
    beyond, edge = 2 * most + len(b) - len(a), last
    for j, token in enumerate(b):
        equal = at.get(token, 0) >> j & full
        same = ((equal & up) + up ^ up | equal | down) & full
        more, less, moved = down | (same | up) ^ full, same & up, same >> 1
        if j < turn:
            if not same & last:
                found += 1
                if found > beyond:
                    return None
        else:
            edge >>= 1
            found += 1 if more & edge else -1 if less & edge else 0
        up, down = less | (moved | more) ^ full, moved & more
    return found if found <= most else None


def edits(a: list, b: list) -> int:
    """Least token edits; one column is kept. Equal beginnings and ends cost nothing. Lists of few edits need only the
    cells near the diagonal; the others take whole columns. Where one list only lacks tokens of the other, one pass is enough."""
    lo, most = 0, min(len(a), len(b))
    while lo < most and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < most - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    rest = iter(a)
    if all(token in rest for token in b):  # nothing but left out: no path has fewer edits than the lengths differ
        return len(a) - len(b)
    few = max(len(a) - len(b), len(a) // 8)
    if 3 * few < len(a) and (found := _near(a, b, few)) is not None:
        return found
    up, down = (1 << len(a)) - 1, 0
    for up, down, _ in _columns(a, b):
        pass
    return len(b) + up.bit_count() - down.bit_count()


def compare(reference: list[str], output: list[str]) -> dict[str, int]:
    """Edits of a cheapest path; going back it prefers a match or substitution, then a deletion.

    Of the table only two bits a cell are kept.
    """
    i, j, size = len(reference), len(output), len(reference) // 8 + 1
    up, down, bits = (1 << i) - 1, 0, [(b"\xff" * size, b"")]
    for up, down, same in _columns(reference, output):
        bits.append((up.to_bytes(size, "little"), same.to_bytes(size, "little")))
    n = dict(reference_words=i, output_words=j, edits=j + up.bit_count() - down.bit_count(), matches=0, substitutions=0, deletions=0, insertions=0)
    bit = lambda number: number[i - 1 >> 3] >> (i - 1 & 7) & 1
    while i or j:
        if i and j and (reference[i - 1] == output[j - 1] or not bit(bits[j][1])):
            n["matches" if reference[i - 1] == output[j - 1] else "substitutions"] += 1
            i, j = i - 1, j - 1
        elif i and bit(bits[j][0]):
            n["deletions"] += 1
            i -= 1
        else:
            n["insertions"] += 1
            j -= 1
    return n


def _lists(made, *columns: pa.Array) -> pa.Array:
    """An array of lists of texts, made from a few rows at a time: as Python texts they take many times the room."""
    kind, size = pa.list_(pa.string()), np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(), dtype="int64")
    parts, lo = [pa.array([], kind)], 0
    while lo < len(size):
        fit = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _BYTES, "right"))
        n = max(1, min(_ROWS, fit - lo))
        parts.append(pa.array([made(*row) for row in zip(*[c.slice(lo, n).to_pylist() for c in columns])], kind))
        lo += n
    return pa.concat_arrays(parts)


@F.arrow_udf(T.ArrayType(T.StringType()))
def tokens(text: pa.Array) -> pa.Array:
    return _lists(tokens_of, text)


@F.arrow_udf(T.IntegerType())
def token_count(text: pa.Array) -> pa.Array:
    """Size of ``tokens``, 0 for null: one text at a time is a Python object, and only numbers go back."""
    return pa.array([count_of(t.as_py()) for t in text], pa.int32())


@F.arrow_udf(T.ArrayType(T.StringType()))
def units(text: pa.Array, language: pa.Array) -> pa.Array:
    return _lists(units_of, text, language)


def _coded(a: pa.ListArray, b: pa.ListArray):
    """Rows of two arrays of lists as numbers, equal for equal texts; None for a missing list."""
    for lo in range(0, len(a), _ROWS):
        both = [x.slice(lo, _ROWS) for x in (a, b)]
        flat = [x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()) for x in both]
        codes = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode").indices.to_numpy()
        sides = []
        for x, own in zip(both, (codes[: len(flat[0])], codes[len(flat[0]) :])):
            at = x.offsets.to_numpy() - x.offsets[0].as_py()
            sides.append([own[i:j].tolist() if there else None for i, j, there in zip(at, at[1:], x.is_valid().to_pylist())])
        yield from zip(*sides)


@F.arrow_udf(T.IntegerType())
def distance(reference: pa.Array, output: pa.Array) -> pa.Array:
    """Least token edits between two arrays; null where one is null. Words stay in Arrow, only their numbers reach Python."""
    return pa.array([None if a is None or b is None else edits(a, b) for a, b in _coded(reference, output)], pa.int32())


METRICS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("reference_words", "output_words", "edits", "matches", "substitutions", "deletions", "insertions")])


@F.pandas_udf(METRICS)
def metrics(reference: pd.Series, output: pd.Series) -> pd.DataFrame:
    names = METRICS.names
    return pd.DataFrame([compare(tokens_of(a), tokens_of(b)) for a, b in zip(reference, output)], columns=names).astype("int32")


def score(pairs: DataFrame) -> DataFrame:
    """Metrics of each (reference, hypothesis) row beside its other columns."""
    m = pairs.withColumn("m", metrics("reference", "hypothesis")).select(*[c for c in pairs.columns], "m.*")
    return m.withColumn("word_count_gap", F.col("reference_words") - F.col("output_words")).withColumn("reference_edit_percent", 100 * F.col("edits") / F.greatest("reference_words", F.lit(1)))


def error_rate(errors: Column, reference: Column) -> Column:
    """Errors per reference unit, four decimals, half-even."""
    return F.bround(errors / F.greatest(reference, F.lit(1)), 4)


def repeats(text: str | None) -> bool:
    """One token six times in a row, or a pair or triple four times, in a text of eight tokens or more."""
    t = _TOKEN.findall(unicodedata.normalize("NFKC", text or "").casefold())
    if len(t) < 8:
        return False
    for size, times in ((1, 6), (2, 4), (3, 4)):
        least = size * (times - 1)
        if sum(map(operator.eq, t, t[size:])) < least:
            continue
        run = 0
        for a, b in zip(t, t[size:]):
            run = run + 1 if a == b else 0
            if run >= least:
                return True
    return False


@F.pandas_udf(T.BooleanType())
def repetitive(text: pd.Series) -> pd.Series:
    return text.map(repeats)
