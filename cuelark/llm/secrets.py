"""Secret scans over an incremental blob ledger.

Each version of a file is addressed by the SHA-256 of its text. Only pairs of blob and rule
version that the ledger does not hold are scanned, one text per blob however many paths carry
it; findings are joined back to all paths. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep

# A private key: from BEGIN over whatever lines to END, header lines and written \n included; five
# dashes end the body, so it never runs into another key. Without END up to the last line of
# base64. Possessive repeats: a key may be as long as it likes.
_GAP = r"(?:[\x20\t\r\n]|\\[nr])*+"
_BODY = r"(?:[^-]++|-{1,4}+[^-])*+-----END [A-Z ]*PRIVATE KEY-----"
_LINES = rf"(?:{_GAP}(?:[A-Za-z0-9+/=]{{16,}}+|(?:Proc-Type|DEK-Info): [^\r\n\\]*+))*+(?:{_GAP}[A-Za-z0-9+/]{{1,15}}+={{1,2}}+)?"
_PEM = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_BODY}|{_LINES})"

# Rule name, pattern (Java syntax, ASCII case), group that must be long enough, least length.
RULES = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("github", r"gh[pousr]_[A-Za-z0-9]{30,}", 0, 34),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    ("stripe", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    ("pem", _PEM, 0, 20),
)
BASE = ("assign", "access", "hex")
RULE_VERSION = "4"
#: Keys over which the copies of one blob are dealt when findings join back.
SPREAD = 16
#: A text can hold a finding of the rule only if this matches; cheaper than listing matches.
GATES = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "hex": r"[0-9a-f]{32}", "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----"}


def gate(text: Column, rules=RULES) -> Column:
    found = F.lit(False)
    for name, pattern, _, _ in rules:
        found = found | text.rlike(GATES.get(name, pattern))
    return found


def findings_of(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rule_no, kind, start, stop) of all matches in (blob, text); code points, end exclusive.

    Matches are leftmost and non-overlapping per rule, and too short ones are dropped after
    matching, so they still consume their characters. Start positions come from a running sum
    over the texts between matches and the matches themselves.
    """
    lists = []
    for no, (kind, pattern, group, _) in enumerate(rules):
        matches = F.arrays_zip(
            F.transform(F.split("text", pattern, -1), F.length).alias("gap"),
            F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.length).alias("whole"),
            F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), F.length).alias("part"),
        )
        lists.append(F.when(F.col("text").rlike(GATES.get(kind, pattern)), F.struct(F.lit(no).alias("rule_no"), matches.alias("matches"))))
    kinds = F.array(*[F.lit(r[0]) for r in rules])
    least = F.array(*[F.lit(r[3]) for r in rules])
    each = blobs.filter(gate(F.col("text"), rules)).select("blob", F.explode(F.array(*lists)).alias("rule")).filter("rule is not null")
    rows = each.select("blob", "rule.rule_no", F.posexplode("rule.matches")).distinct()  # the same path and text twice give the same rows
    run = Window.partitionBy("blob", "rule_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("stop", F.sum((F.col("col.gap") + F.coalesce("col.whole", F.lit(0))).cast("long")).over(run))
        .filter(F.col("col.part") >= F.get(least, F.col("rule_no")))
        .select("blob", "rule_no", F.get(kinds, F.col("rule_no")).alias("kind"), (F.col("stop") - F.col("col.whole")).alias("start"), "stop")
    )


def address(versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, blob, text): a null text is empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob"), body.alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings of the blobs not yet in ``ledger`` (blob, rule_version), and the rows to add to it.

    ``versions`` is what :func:`address` returns. One path stands for a blob: the smallest; if
    the same path and blob come more than once, the scan still sees the text once.
    """
    stand = versions.groupBy("blob").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))
    if ledger is not None:
        stand = stand.join(ledger.filter(F.col("rule_version") == rule_version), "blob", "left_anti")
    null_safe = versions.alias("v").join(stand.alias("s"), F.col("v.path").eqNullSafe(F.col("s.path")) & (F.col("v.blob") == F.col("s.blob")), "left_semi")
    findings = findings_of(null_safe.select("blob", "text"), rules).distinct()
    return findings, stand.select("blob", F.lit(rule_version).alias("rule_version"))


def findings_by_blob(findings: DataFrame) -> DataFrame:
    """One row per blob: its findings ordered by start, then rule."""
    return findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rule_no", "stop", "kind"))).alias("found"))


def joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with ``blob`` beside ``found`` of their blob; the rows of one blob are dealt over ``SPREAD`` keys, for it may have very many."""
    many = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SPREAD)).cast("int")).join(many, ["blob", "salt"], "left").drop("salt")


def scan_paths(versions: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(path, blob, found) for every row of ``versions``; ``known`` holds findings of blobs scanned before."""
    fresh, _ = scan(versions, ledger)
    return on_paths(versions, fresh if known is None else fresh.unionByName(known).distinct())


def on_paths(versions: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, blob, found) for every row of ``versions`` from findings of its blobs."""
    found = findings_by_blob(findings)
    return joined(versions.select("path", "blob"), found).withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))


class Ledger:
    """What has been scanned, as two Parquet tables below ``root``: pairs of blob and rule version, and findings.

    Findings are written before the pairs, so a scan that breaks off in between is done again and
    its findings come twice, which reading them undoes. One scan at a time.
    """

    ENTRIES = "blob string, rule_version string"
    FINDINGS = "blob string, rule_no int, kind string, start long, stop long, rule_version string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        for name, schema in (("entries", self.ENTRIES), ("findings", self.FINDINGS)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/{name}")

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.ENTRIES).parquet(f"{self.root}/entries")

    def findings(self, rule_version: str = RULE_VERSION) -> DataFrame:
        rows = self.spark.read.schema(self.FINDINGS).parquet(f"{self.root}/findings")
        return rows.filter(F.col("rule_version") == rule_version).drop("rule_version").distinct()

    def scan(self, versions: DataFrame, rules=RULES, rule_version: str = RULE_VERSION) -> int:
        """Scans the blobs of ``versions`` that this rule version hasn't seen; returns how many these were."""
        fresh, new = scan(versions, self.entries(), rules, rule_version)
        new = keep(new, "entries")
        fresh.withColumn("rule_version", F.lit(rule_version)).write.mode("append").parquet(f"{self.root}/findings")
        new.write.mode("append").parquet(f"{self.root}/entries")
        return new.count()


def spelled(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest(paths: DataFrame) -> DataFrame:
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return paths.select(F.col("path").alias("doc_id"), *map(count, BASE), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))


def redact(found: Column, text: Column, mark: str = "[secret]") -> Column:
    """``text`` with every finding replaced by ``mark``; overlapping findings merge.

    ``found`` is ordered by start. The fold keeps the pieces written so far and the end of the
    text already handled; it touches each finding once.
    """
    done = F.aggregate(
        found,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["stop"]).alias("at"),
        ),
    )
    return F.concat(F.array_join(done["out"], ""), F.substr(text, (done["at"] + 1).cast("int")))
