"""Language-model scoring by subword lattices.

A word's backing probability is the sum over all its segmentations into pieces of an existing
subword vocabulary, found by a forward recursion in log space. The vocabulary's own scores weigh
the segmentations of every training word; the occurrences of pieces that this expects and, with a
stated share, the scores themselves are the weights of each class. A word seen in training is one
more arc of the lattice, spanning the whole word, weighed by absolutely discounted counts, first
over the whole corpus and then within a class of documents (here: a language). A document's probability is the sum over classes of the class weight times the
product of its words' and its end's probabilities. Neither the class nor any label of a scored
document is looked at: it is summed out.

Counts, vocabulary totals and piece counts cover all training rows. Frequent words (a bounded
table) are broadcast; all others meet their counts in a join by word. A word outside the table has
fewer uses than each of its ``HEAD_WORDS`` words (words of about equal use apart), so no key of that
join holds more than about one in ``HEAD_WORDS`` of all words.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc, keep, restored, solid

#: At most so many words are broadcast with their log probabilities.
HEAD_WORDS = 300_000
#: A task's counts are handed on when it holds so many words.
FLUSH = 400_000
#: Classes of the model: the commonest values have counts of their own, all rarer ones share the last.
CLASSES = 8
#: The end of a text; no word holds a space.
END = b" "
LN10 = math.log(10)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case: bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


# ---------------------------------------------------------------- training


def _count(classes: int):
    def run(batches):
        seen = [Counter() for _ in range(classes + 1)]

        def flush():
            words = [w for c in seen for w in c]
            out = pd.DataFrame({"word": pd.Series(words, dtype=object), "k": np.repeat(np.arange(classes + 1, dtype="int32"), [len(c) for c in seen]), "n": np.array([n for c in seen for n in c.values()], "int64")})
            for c in seen:
                c.clear()
            return out

        for b in batches:
            for text, k in zip(b["text"], b["k"]):
                seen[k].update(words_of(text))
                seen[k][END] += 1
                if sum(map(len, seen)) > FLUSH:
                    yield flush()
        yield flush()

    return run


_RADIX = np.uint64(0x9E3779B97F4A7C15)


def _points(words: list[str]) -> np.ndarray:
    """Code points [word, position] of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype("uint64")


def _span_hashes(points: np.ndarray, longest: int) -> list[np.ndarray]:
    """64-bit hashes [word, start] of all spans of length 1, 2, ... ``longest``."""
    out = [points + np.uint64(1)]
    for n in range(2, min(longest, points.shape[1]) + 1):
        out.append(out[-1][:, :-1] * _RADIX + points[:, n - 1 :] + np.uint64(1))
    return out


class Pieces:
    """An existing subword vocabulary: its pieces, its bytes, and the prior its own scores give.

    The prior is exp(score) where scores are log probabilities, and one over the rank where they
    are merge ranks (0, -1, -2, ...).
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        usable = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = {i: sp.get_score(i) for i in usable}
        ranked = all(x <= 0 and x == int(x) for x in score.values())
        prior = np.zeros(self.size)
        prior[usable] = [1 / (2 - score[i]) if ranked else math.exp(score[i]) for i in usable]
        self.prior = prior / prior.sum()
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in usable if sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in usable if not sp.is_byte(i)}
        self.longest = max(map(len, self.ids), default=1)
        #: for each length the hashes of its pieces in order, and their ids
        self.tables = []
        for n in range(1, self.longest + 1):
            own = [w for w in self.ids if len(w) == n] or ["\0" * n]
            h = _span_hashes(_points(own), n)[-1][:, 0]
            by = np.argsort(h)
            there = np.zeros(1 << 20, bool)
            there[h >> np.uint64(44)] = True  # tells most spans apart before the search
            self.tables.append((h[by], np.array([self.ids.get(w, self.size) for w in own], "int32")[by], there))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


#: Passes of expecting piece counts, and the weight of the vocabulary's scores for each expected piece.
PASSES, PRIOR_SHARE = 1, 0.1
#: A log weight that no path takes.
NEVER = -1e30


def log_weights(vocabulary: Pieces, counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log weights [piece, class] and of a word's end [class]; each class sums to one.

    ``counts`` [piece, class] are the (expected) occurrences in ``words`` [class] words.
    """
    seen = counts.sum(0)
    extra = np.maximum(1.0, PRIOR_SHARE * seen)
    ends = np.maximum(1.0, words)
    with np.errstate(divide="ignore"):
        w = np.log((counts + extra * vocabulary.prior[:, None]) / (seen + extra + ends))
    return np.maximum(w, NEVER), np.log(ends / (seen + extra + ends))


def _arcs(words: list[str], vocabulary: Pieces, weights: np.ndarray):
    """Words of one length: piece of each span [word, end, length - 1], and ``weights`` with rows for
    characters that are no piece (spelled in bytes) and for spans that are none."""
    points, none = _points(words), vocabulary.size
    n = points.shape[1]
    span = min(n, vocabulary.longest)
    table = np.full((len(words), n + 1, span), none, "int32")
    for k, h in enumerate(_span_hashes(points, span)):
        keys, ids, there = vocabulary.tables[k]
        row, start = np.nonzero(there[h >> np.uint64(44)])
        h = h[row, start]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        table[row, start + k + 1, k] = np.where(keys[at] == h, ids[at], none)
    single = table[:, 1:, 0]
    odd = single == none
    strange: list[str] = []
    if odd.any():
        chars, which = np.unique(points[odd], return_inverse=True)
        strange = [chr(c) for c in chars.tolist()]
        single[odd] = none + 1 + which.astype("int32")
    spelled = [[vocabulary.byte[c] for c in x.encode("utf-8", "surrogatepass") if c in vocabulary.byte] for x in strange]
    more = [np.full(weights.shape[1], NEVER), *(weights[b].sum(0) if b else np.full(weights.shape[1], -700.0) for b in spelled)]
    return table, np.vstack([weights, *more]), spelled


def forward(table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-space forward recursion [word, position, class]: the last position holds the log of the
    sum over all segmentations of the product of piece weights."""
    many, ends, span = table.shape
    alpha = np.zeros((many, ends, weights.shape[1]))
    for i in range(1, ends):
        m = min(i, span)
        terms = alpha[:, i - m : i][:, ::-1] + weights[table[:, i, :m]]
        top = terms.max(1)
        alpha[:, i] = top + np.log(np.exp(terms - top[:, None]).sum(1))
    return alpha


def expected(table: np.ndarray, weights: np.ndarray, alpha: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected occurrences [piece, class] over all segmentations; ``times`` [word, class] weighs the words."""
    many, ends, span = table.shape
    out = np.zeros_like(weights)
    beta = np.full_like(alpha, NEVER)
    beta[:, -1] = 0.0
    whole = alpha[:, -1:]
    places, shares = [], []
    for i in range(ends - 1, 0, -1):
        m = min(i, span)
        at = table[:, i, :m]
        step = weights[at] + beta[:, i : i + 1]
        there = beta[:, i - m : i]
        high = np.maximum(there, step[:, ::-1])
        beta[:, i - m : i] = high + np.log1p(np.exp(-np.abs(there - step[:, ::-1])))
        places.append(at.ravel())
        shares.append((np.exp(alpha[:, i - m : i][:, ::-1] + step - whole) * times[:, None]).reshape(-1, weights.shape[1]))
    place, share = np.concatenate(places), np.concatenate(shares)
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(place, share[:, k], len(weights))
    return out


def _same_length(words: list[str], span: int, classes: int, most: int = 4_000_000):
    """Positions of words of one length, in groups whose arrays stay small."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, at in by.items():
        step = max(1, most // (n * min(n, span) * classes))
        for x in range(0, len(at), step):
            yield at[x : x + step]


def _gathered(batches, most: int = 20_000):
    """Batches of words put together, so that arrays are worth their overhead."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= most:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _spelled(raw: bytes) -> str:
    return "\u2581" + raw.decode("utf-8", "replace")


def _expect(path: str, shared, classes: int):
    cs = [f"c{k}" for k in range(classes)]

    def run(batches):
        vocabulary, (weights, _) = pieces_of(path), shared.value
        total = np.zeros((vocabulary.size, classes))
        for b in _gathered(batches):
            words = [_spelled(w) for w in b["word"]]
            inside = b[cs].to_numpy() > 0
            for k in range(classes):  # a word belongs to few classes: each class takes its own
                own = np.flatnonzero(inside[:, k]).tolist()
                for at in _same_length([words[i] for i in own], vocabulary.longest, 1):
                    table, w, strange = _arcs([words[own[i]] for i in at], vocabulary, weights[:, k : k + 1])
                    got = expected(table, w, forward(table, w), np.ones((len(at), 1)))[:, 0]
                    total[:, k] += got[: vocabulary.size]
                    for n, spelled in zip(got[vocabulary.size + 1 :], strange):
                        for c in spelled:
                            total[c, k] += n
        piece, k = np.nonzero(total)
        yield pd.DataFrame({"piece": piece.astype("int32"), "k": k.astype("int32"), "n": total[piece, k]})

    return run


class Model:
    """Totals of the training rows: a few numbers a class."""

    def __init__(self, classes: int, totals: dict):
        self.classes = classes
        self.n, self.v = totals["n"] or 0, totals["v"] or 0
        singles, pairs = totals["n1"] or 0, totals["n2"] or 0
        self.discount = min(0.95, max(0.1, singles / (singles + 2 * pairs))) if singles else 0.5
        self.class_n = [totals[f"s{k}"] or 0 for k in range(classes)]
        self.class_v = [totals[f"t{k}"] or 0 for k in range(classes)]
        ends = [totals[f"e{k}"] or 0 for k in range(classes)]
        self.weight = [e / sum(ends) if sum(ends) else 1 / classes for e in ends]
        #: log10 of the share that falls to the backing model: of the corpus, and of each class
        self.back = math.log10(self.discount * self.v / self.n) if self.n else 0.0
        self.class_back = [math.log10(self.discount * v / n) if n else 0.0 for v, n in zip(self.class_v, self.class_n)]

    def arrays(self, c: np.ndarray, counts: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """log10 of words' probabilities, a column a class; ``lat`` [word, class]."""
        out = []
        for k in range(self.classes):
            apart = self.back + lat[:, k]
            whole = np.logaddexp(apart * LN10, np.log(np.maximum(c - self.discount, 1e-300) / max(self.n, 1))) / LN10
            own, back = counts[:, k], self.class_back[k] + np.where(c > 0, whole, apart)
            seen = np.logaddexp(back * LN10, np.log(np.maximum(own - self.discount, 1e-300) / max(self.class_n[k], 1))) / LN10
            out.append(np.where(own > 0, seen, back))
        return np.stack(out, 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


def _probabilities(path: str, shared, model: Model):
    """Of each word its log10 probability in each class, in the base model, and whether training rows have it."""
    classes = model.classes
    cs = [f"c{k}" for k in range(classes)]

    def run(batches):
        vocabulary, (weights, end) = pieces_of(path), shared.value
        for b in _gathered(batches):
            words = [_spelled(w) for w in b["word"]]
            out = np.zeros((len(words), classes))
            for at in _same_length(words, vocabulary.longest, classes):
                table, w, _ = _arcs([words[i] for i in at], vocabulary, weights)
                out[at] = (forward(table, w)[:, -1] + end) / LN10
            c = b["c"].to_numpy("float64")
            each = model.arrays(c, b[cs].to_numpy("float64"), out)
            yield b[["word", "uses"]].assign(**{f"l{k}": each[:, k] for k in range(classes)}, base=model.base(c), known=(c > 0).astype("float64"))

    return run


def _sum_class(k: int):
    return F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"c{k}")


def train(source: DataFrame, classes: int, vocabulary: str) -> tuple[Model, DataFrame]:
    """The model, and its numbers for every word of the corpus. ``source``: text, k (class of a training row; ``classes`` itself for rows not learned from)."""
    counted = source.select("text", "k").mapInPandas(_count(classes), "word binary, k int, n long")
    cs = [f"c{k}" for k in range(classes)]
    raw = keep(counted.groupBy("word").agg(*[_sum_class(k) for k in range(classes)], F.sum("n").alias("uses")).withColumn("c", sum((F.col(c) for c in cs), F.lit(0)).cast("long")), "counts")
    ask = [F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")]
    for k in range(classes):
        ask += [F.sum(f"c{k}").alias(f"s{k}"), F.count_if(F.col(f"c{k}") > 0).alias(f"t{k}"), F.sum(F.when(F.col("word") == F.lit(END), F.col(f"c{k}"))).alias(f"e{k}")]
    totals = raw.agg(*ask).first().asDict()
    tasks = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = raw.filter((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word", *cs).repartition(tasks, "word")
    pieces, share = pieces_of(vocabulary), source.sparkSession.sparkContext.broadcast
    types = np.array([max(0, (totals[f"t{k}"] or 0) - 1) for k in range(classes)], "float64")
    weights = log_weights(pieces, np.zeros((pieces.size, classes)), np.zeros(classes))
    for _ in range(PASSES):
        got = np.zeros((pieces.size, classes))
        # a row a piece and class, whatever the input
        for r in known.mapInPandas(_expect(vocabulary, share(weights), classes), "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).collect():
            got[r["piece"], r["k"]] = r["n"]
        weights = log_weights(pieces, got, types)
    model = Model(classes, totals)
    # by word, so that the lattice work spreads evenly over tasks
    shape = "word binary, uses long, " + ", ".join(f"{x} double" for x in _numbers(classes))
    return model, keep(raw.repartition(tasks, "word").mapInPandas(_probabilities(vocabulary, share(weights), model), shape), "words")


def _numbers(classes: int) -> list[str]:
    return [*(f"l{k}" for k in range(classes)), "base", "known"]


# ---------------------------------------------------------------- scoring


def _head(words: DataFrame, classes: int, most: int) -> tuple[dict[bytes, int], np.ndarray]:
    """{word: row} and the rows' numbers of the ``most`` most used words; where uses lie within 10 % of each other a hash of the word decides."""
    level = F.floor(F.log(F.col("uses").cast("double")) * 10)
    least, total, share = None, 0, 1
    for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():
        least, total, above = r["level"], total + r["words"], total
        if total > most:  # the last level fills what room is left
            share = -(-r["words"] // max(1, most - above))
            break
    if least is None or not most:
        return {}, np.zeros((0, classes + 2))
    some = (level > least) | ((level == least) & (F.pmod(F.xxhash64("word"), F.lit(share)) == 0))
    top = words.filter(some).drop("uses").toArrow()
    return {w.as_py(): i for i, w in enumerate(top["word"])}, np.column_stack([top[x].to_numpy() for x in _numbers(classes)])


def _spread(head, classes: int):
    """Per text one row of what broadcast words add up to (word null), and a row for each other distinct word."""
    names = _numbers(classes)

    def run(batches):
        rows, numbers = head.value
        for t in batches:
            sums = np.zeros((len(t), classes + 2))
            many, rest, words_out, times_out = [], [], [], []
            for d, text in enumerate(t["text"]):
                words = Counter(words_of(text))
                many.append(sum(words.values()) + 1)
                words[END] += 1
                at = list(map(rows.get, words))
                times = list(words.values())
                if None in at:
                    own = [(w, n) for w, n, i in zip(words, times, at) if i is None]
                    words_out += [w for w, _ in own]
                    times_out += [n for _, n in own]
                    rest.append(len(own))
                    times = [n for n, i in zip(times, at) if i is not None]
                    at = [i for i in at if i is not None]
                else:
                    rest.append(0)
                if at:
                    sums[d] = np.array(times, "float64") @ numbers[at]
            size = len(t)
            who = np.concatenate([np.arange(size), np.repeat(np.arange(size), rest)])
            first = np.arange(len(who)) < size
            out = {"doc_id": t["doc_id"].to_numpy()[who], "held_out": t["held_out"].to_numpy()[who], "a": t["a"].to_numpy()[who], "b": t["b"].to_numpy()[who], "n_tokens": np.where(first, np.array(many, "int64")[who], 0)}
            out |= {"word": pd.Series([None] * size + words_out, dtype=object), "times": np.array([1] * size + times_out, "int64")}
            sums = np.vstack([sums, np.zeros((len(who) - size, classes + 2))])
            yield pd.DataFrame(out | {x: sums[:, i] for i, x in enumerate(names)})

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", class_column: str | None = "lang", folds: int = 10, held_fold: int = 0, vocabulary: str | None = None, head_limit: int = HEAD_WORDS, most_classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held_fold`` are not learned from; so are
    rows with a null id, which count as not held out. A null text is empty: it has the end alone.
    Rows with equal id and text get equal scores, a row each. Without rows to learn from, words
    have their lattice probability alone. Classes are the ``most_classes`` - 1 commonest values of
    ``class_column`` in training rows, ties by value, and one for all others; that is part of the
    model, and every row counts in its class. About ``head_limit`` words are broadcast, which
    changes no score.
    """
    vocabulary = vocabulary or default_vocabulary()
    body = F.coalesce(F.col(text), F.lit(""))
    held = (crc(F.col(doc_id)) % folds) == held_fold
    label = F.coalesce(F.col(class_column).cast("string"), F.lit("")) if class_column and class_column in docs.columns else F.lit("")
    source = docs.select(
        solid(doc_id).alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), held.alias("fold"), label.alias("label"), body.alias("text"),
        F.xxhash64(F.col(doc_id), body).alias("a"), F.xxhash64(F.lit(1), body, F.col(doc_id)).alias("b"),
    )
    names = [r["label"] for r in source.filter(~F.col("fold")).groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_classes - 1).collect()]
    classes = len(names) + 1
    k = F.lit(len(names))
    for i, name in enumerate(names):
        k = F.when(F.col("label") == name, F.lit(i)).otherwise(k)
    source = source.withColumn("k", F.when(F.col("fold").isNull() | F.col("fold"), F.lit(classes)).otherwise(k).cast("int"))
    model, words = train(source, classes, vocabulary)
    head = docs.sparkSession.sparkContext.broadcast(_head(words, classes, head_limit))
    ls, numbers = [f"l{k}" for k in range(classes)], _numbers(classes)
    doubles = ", ".join(f"{x} double" for x in numbers)
    spread = keep(source.select("doc_id", "held_out", "a", "b", "text").mapInPandas(_spread(head, classes), f"doc_id long, held_out boolean, a long, b long, n_tokens long, word binary, times long, {doubles}"), "spread")
    tails = spread.filter("word is not null").select("a", "b", "word", "times").join(words.drop("uses"), "word")
    tails = tails.groupBy("a", "b").agg(*[F.sum(F.col(x) * F.col("times")).alias(f"t_{x}") for x in numbers])
    # equal rows (same id and text) put in their words once each: divide by how often they come
    same = spread.filter("word is null")
    copies = same.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"))
    whole = same.join(tails.join(copies, ["a", "b"]), ["a", "b"], "left")
    add = lambda x: F.col(x) + F.coalesce(F.col(f"t_{x}") / F.col("copies"), F.lit(0.0))
    sums = F.array(*[add(x) + math.log10(w) if w else F.lit(float("-inf")) for x, w in zip(ls, model.weight)])
    whole = whole.withColumn("s", sums).withColumn("top", F.array_max("s"))
    total = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x - F.col("top")))
    return whole.select(
        restored("doc_id").alias("doc_id"), "held_out", "n_tokens", F.round(add("known")).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), add("base").alias("base_score"), (F.col("top") + F.log10(total)).alias("score")
    )
