"""Streams with state of their own: words regrouped where they arrive, and messages held back.

Both run as ``transformWithStateInPandas`` and need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``, see :data:`ROCKSDB`).
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.ranges import placed
from ..operators.sequence import Fresh, WordCues, finished

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a stream of words carries: (project, track) and these.
FIELDS = ("start", "end", "word", "chunk", "language", "flags", "hint")
PIECE = "project string, track int, piece double, place int, start double, last double, text string, language string, n_words long, flags array<string>, hints array<string>"
EVENT = "key string, at double, status string, message string, held boolean"


class Piece:
    """Words between two safe cuts, dropped ones included, and what is known at its end.

    A cut is safe before a word if every cue restarts there (a pause or another language) and no
    word from then on can be one of the last kept words heard twice: whatever comes later, both
    sides fold as they do now.
    """

    def __init__(self):
        self.words, self.kept, self.numbers = [], [], []
        self.fresh, self.group = Fresh(), WordCues()

    def cut_before(self, word: tuple) -> bool:
        start, _, _, _, language, *_ = word
        rests = self.kept and (language != self.group.language or start - self.group.end > self.group.gap)
        return bool(rests) and all(at + self.fresh.near <= 2 * start for _, at, _ in self.fresh.kept)

    def add(self, word: tuple) -> None:
        start, end, text, chunk, language, *_ = word
        self.words.append(word)
        if self.fresh(start, end, chunk, text):
            self.kept.append(word)
            self.numbers.append(self.group(start, end, language, text))

    def cues(self) -> list[tuple]:
        """(place, start, last, text, language, n_words, flags, hints) of each cue."""
        out, at = [], 0
        while at < len(self.numbers):
            to = at
            while to < len(self.numbers) and self.numbers[to] == self.numbers[at]:
                to += 1
            words = self.kept[at:to]
            flags, hints = {f for w in words for f in w[5]}, {w[6] for w in words if w[6] is not None}
            out.append((len(out), words[0][0], words[-1][1], "".join(w[2] for w in words), words[0][4], len(words), sorted(flags), sorted(hints)))
            at = to
        return out


def split(words: list[tuple]) -> list[Piece]:
    """Words in order as pieces between safe cuts."""
    pieces: list[Piece] = []
    for word in words:
        if not pieces or pieces[-1].cut_before(word):
            pieces.append(Piece())
        pieces[-1].add(word)
    return pieces


def _order(word: tuple) -> tuple:
    return word[0], word[1], word[2], word[3] is not None, word[3]


class Regroup(StatefulProcessor):
    """State of a track: where its pieces begin, and each piece's words.

    New words touch the pieces that they fall into. Folding begins at the piece before, and goes
    on behind only while the next piece no longer begins with a safe cut; all others are neither
    read nor folded. Words may come in any order and as late as they like.
    """

    def init(self, handle) -> None:
        self.index = handle.getValueState("index", "starts array<double>")
        self.pieces = handle.getMapState("pieces", "start double", "words binary")

    def _words(self, start: float) -> list[tuple]:
        return pickle.loads(self.pieces.getValue((start,))[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for b in rows:
            clean = lambda c: [x if isinstance(x, str) else None for x in b[c]]  # noqa: E731, B023
            flags = [list(x) if x is not None else [] for x in b["flags"]]
            chunks = [None if x != x or x is None else int(x) for x in b["chunk"].tolist()]
            new += zip(b["start"].tolist(), b["end"].tolist(), clean("word"), chunks, clean("language"), flags, clean("hint"))
        if not new:
            return
        starts = list(self.index.get()[0]) if self.index.exists() else []
        touched = {max(0, bisect.bisect_right(starts, w[0]) - 1) for w in new}
        at, out = 0, []
        pending = sorted(new, key=_order)
        while touched:
            first = min(touched)
            lo = max(0, first - 1)
            hi, words = lo, []
            # a run of neighbouring pieces that have to be folded together
            while hi < len(starts) and (hi <= first or hi in touched or hi - 1 in touched):
                words += self._words(starts[hi])
                hi += 1
            until = starts[hi] if hi < len(starts) else float("inf")
            mine = [w for w in pending if w[0] < until]
            pending = pending[len(mine) :]
            made = split(sorted(words + mine, key=_order))
            while hi < len(starts) and (not made[-1].cut_before((beyond := self._words(starts[hi]))[0]) or hi in touched):
                hi += 1
                until = starts[hi] if hi < len(starts) else float("inf")
                more = [w for w in pending if w[0] < until]
                pending = pending[len(more) :]
                tail = made.pop()
                made += split(sorted([*tail.words, *beyond, *more], key=_order))
            touched = {t for t in touched if t >= max(hi, first + 1)}
            out.append((lo, hi, made))
        gone, kept = [], []
        for lo, hi, made in out:
            kept += starts[at:lo]
            at = hi
            gone += starts[lo:hi]
            for piece in made:
                kept.append(piece.words[0][0])
        kept += starts[at:]
        rows_out = []
        for start in gone:
            self.pieces.removeKey((start,))
        for _, _, made in out:
            for piece in made:
                start = piece.words[0][0]
                self.pieces.updateValue((start,), (pickle.dumps(piece.words),))
                rows_out += [(*key, start, *cue) for cue in piece.cues()]
        self.index.update((kept,))
        now = {p.words[0][0] for _, _, made in out for p in made}
        rows_out += [(*key, start, -1, None, None, None, None, None, None, None) for start in gone if start not in now]
        yield pd.DataFrame(rows_out, columns=[c.split()[0] for c in PIECE.split(", ")]).astype({"n_words": "Int64"})

    def close(self) -> None:
        pass


def cue_pieces(words: DataFrame) -> DataFrame:
    """Stream of words (project, track, start, end, word, chunk, language; optional flags, language_hint) to the cues of the pieces they change.

    A row a cue of a changed piece, in place of all that the piece had before; ``place`` -1 means
    that the piece is no more. No watermark is set: late words belong before earlier ones.
    """
    flags = F.coalesce(F.col("flags"), F.array().cast("array<string>")) if "flags" in words.columns else F.array().cast("array<string>")
    hint = F.col("language_hint") if "language_hint" in words.columns else F.lit(None).cast("string")
    rows = words.select("project", F.col("track").cast("int").alias("track"), "start", "end", "word", "chunk", "language", flags.alias("flags"), hint.alias("hint"))
    return rows.groupBy("project", "track").transformWithStateInPandas(Regroup(), PIECE, "Update", "None")


def replace_pieces(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored pieces with the changed ones put in the place of what they had; applying a batch twice gives the same."""
    keys = ["project", "track", "piece"]
    return stored.join(changed.select(*keys).distinct(), keys, "left_anti").unionByName(changed.filter("place >= 0"))


def cues_of(pieces: DataFrame) -> DataFrame:
    """Stored pieces as cues, numbered along their tracks: what :func:`sequence.cues` makes of all deduplicated words."""
    numbered = placed(pieces, ["project", "track"], ["piece", "place"], "cue").withColumn("cue", F.col("cue").cast("int"))
    return finished(numbered.withColumnRenamed("hints", "language_hints"))


class HoldBack(StatefulProcessor):
    """Passes a message on if it is the first, comes ``least`` seconds after the last one passed, or has a new status; holds it otherwise.

    A newer message takes the place of the one held. A timer lets the held one go when ``least``
    seconds have gone by since it came, so that the last message of a key is never lost.
    """

    def __init__(self, least: float, on_change: bool):
        self.least, self.on_change = least, on_change

    def init(self, handle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "at double, status string")
        self.held = handle.getValueState("held", "at double, status string, message string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.passed.get() if self.passed.exists() else None
        held = self.held.get() if self.held.exists() else None
        out = []
        table = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable")
        for at, status, message in zip(table["at"].tolist(), table["status"].tolist(), table["message"].tolist()):
            if last is None or at - last[0] >= self.least or (self.on_change and status != last[1]):
                out.append((*key, at, status, message, False))
                last, held = (at, status), None
            else:
                held = (at, status, message)
        if last is not None:
            self.passed.update(last)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.least * 1000))
        yield pd.DataFrame(out, columns=["key", "at", "status", "message", "held"]).astype({"at": "float64", "held": "bool"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.held.exists():
            at, status, message = self.held.get()
            out.append((*key, at, status, message, True))
            self.passed.update((at, status))
            self.held.clear()
        yield pd.DataFrame(out, columns=["key", "at", "status", "message", "held"]).astype({"at": "float64", "held": "bool"})

    def close(self) -> None:
        pass


def throttled(messages: DataFrame, least: float = 0.5, on_change: bool = False) -> DataFrame:
    """Stream of (key, at in seconds, status, message) with the rows in between held back; ``held`` marks those that a timer let go."""
    rows = messages.select(F.col("key").cast("string").alias("key"), F.col("at").cast("double").alias("at"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("status", "message")])
    return rows.groupBy("key").transformWithStateInPandas(HoldBack(least, on_change), EVENT, "Append", "ProcessingTime")
