"""The folds as table functions for SQL text.

After :func:`register`::

    SELECT * FROM group_words(TABLE(words) PARTITION BY (project, track) ORDER BY (start, `end`, word))

gives the rows of ``words`` with the number of their cue. ``deduplicate`` marks words heard twice,
``group_cues`` numbers utterances and ``cue_blocks`` transcript blocks. Spark brings the rows of a
partition to one task, in the order asked for; :mod:`operators.sequence` is the form for a track
that is too long for that.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .operators.sequence import Blocks, Fresh, Utterances, WordCues


def _table_function(rule: type, column: str):
    class Fold:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            missing = [c for c in rule.columns if c not in rows.dataType.names]
            if not rows.isTable or missing:
                raise ValueError(f"expected TABLE(...) with the columns {', '.join(rule.columns)}")
            return AnalyzeResult(T.StructType([*rows.dataType.fields]).add(column, T.IntegerType()))

        def __init__(self):
            self.rule = rule()

        def eval(self, row):
            yield (*row, self.rule(*(row[c] for c in rule.columns)))

    return udtf(Fold)


FUNCTIONS = {"group_words": (WordCues, "cue"), "deduplicate": (Fresh, "fresh"), "group_cues": (Utterances, "utterance"), "cue_blocks": (Blocks, "block")}


def register(spark: SparkSession) -> None:
    for name, (rule, column) in FUNCTIONS.items():
        spark.udtf.register(name, _table_function(rule, column))
