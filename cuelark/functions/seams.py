"""Places where outside models plug in: the DataFrame contract around a function that is passed in.

A function is made by a factory on each task, so a model loads once per task and not per row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import shares
from ..operators.tracks import signed

WORD = "project string, track int, chunk int, word string, start double, end double, probability double, language string"


def recognize(windows: DataFrame, make: Callable[[], Callable], offset: str = "start") -> DataFrame:
    """Audio windows (project, track, chunk, start, samples) to words. The recognizer takes samples and returns rows (word, start, end, probability, language) in window time."""

    def run(batches):
        model = make()
        for b in batches:
            rows = []
            for r in b.itertuples():
                at = getattr(r, offset)
                rows += [(r.project, r.track, r.chunk, w, at + s, at + e, p, x) for w, s, e, p, x in model(np.asarray(r.samples, "float32"))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WORD.split(", ")])

    return windows.mapInPandas(run, WORD)


def detect_speech(windows: DataFrame, make: Callable[[], Callable], threshold: float = 0.5) -> DataFrame:
    """Audio windows to speech intervals."""

    def run(batches):
        model = make()
        for b in batches:
            rows = [(r.project, r.track, r.start + s, r.start + e) for r in b.itertuples() for s, e in model(np.asarray(r.samples, "float32"), threshold)]
            yield pd.DataFrame(rows, columns=["project", "track", "start", "end"])

    return windows.mapInPandas(run, "project string, track int, start double, end double")


def detect_language(windows: DataFrame, make: Callable[[], Callable], least: int = 32_000) -> DataFrame:
    """Windows with struct(code, score) beside them; null below ``least`` samples."""

    def run(batches):
        model = make()
        for b in batches:
            found = [model(np.asarray(x, "float32")) if len(x) >= least else None for x in b["samples"]]
            yield b[["project", "track", "start"]].assign(code=[f and f[0] for f in found], score=[f[1] if f else None for f in found])

    return windows.mapInPandas(run, "project string, track int, start double, code string, score double")


def filter_audio(windows: DataFrame, make: Callable[[], Callable], drift: int = 16) -> DataFrame:
    """Windows with filtered samples, finite and as long as before up to ``drift`` samples."""

    def run(batches):
        model = make()
        for b in batches:
            out = []
            for x in b["samples"]:
                y = np.asarray(model(np.asarray(x, "float32")), "float32")
                if abs(len(y) - len(x)) > drift or not np.isfinite(y).all():
                    raise ValueError("the filter changed the length or gave no finite samples")
                out.append(y)
            yield b.assign(samples=out)

    return windows.mapInPandas(run, windows.schema)


def prepare_window(samples: F.Column, length: int) -> F.Column:
    """Exactly ``length`` samples: cut, or padded with silence."""
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), length)), 1, length)


def translate(cues: DataFrame, valid: DataFrame, target: str, make: Callable[[], Callable]) -> DataFrame:
    """Translations of cues whose utterance isn't valid yet: (project, track, cue_id, text, individually).

    One call per utterance, dealt to its cues by duration; where the answer is too short each cue
    gets a call of its own. Cues already in the target language are copied.
    """
    groups = signed(cues).select("project", "track", "utterance", "members").distinct()
    open_ = signed(cues).join(valid.select(F.col("cue_id").alias("id")).distinct(), "id", "left_anti").select("project", "track", "utterance").distinct()
    todo = groups.join(open_, ["project", "track", "utterance"], "left_semi")

    def run(batches):
        model = make()
        for b in batches:
            rows = []
            for project, track, members in zip(b["project"], b["track"], b["members"]):
                texts, source = [m["text"] for m in members], members[0]["language"]
                alone = False
                if source == target:
                    said = texts
                else:
                    spans = [m["end"] - m["start"] for m in members]
                    said = shares(model(source, target, " ".join(texts)), spans, target)
                    if said is None and len(members) > 1:
                        alone = True
                        said = [(shares(model(source, target, t), [d], target) or [None])[0] for t, d in zip(texts, spans)]
                    if said is None or any(x is None for x in said):
                        raise ValueError("the translator returned no speech")
                rows += [(project, track, m["id"], x, alone) for m, x in zip(members, said)]
            yield pd.DataFrame(rows, columns=["project", "track", "cue_id", "text", "individually"])

    return todo.mapInPandas(run, "project string, track int, cue_id string, text string, individually boolean")
