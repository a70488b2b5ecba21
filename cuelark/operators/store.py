"""Tables as Parquet snapshots: a change writes new folders and then claims the next version; nothing that is read is overwritten.

Several writers may work at once. A version is a file with a number that only one writer can
create; whoever comes second starts again from the version that got in before, or, if the two
changed different partitions, only puts the newer list of folders under their own.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import replaced

CUE = "id string, project string, track int, start double, end double, text string, raw_text string, language string, flags array<string>, reviewed boolean, edited boolean"
TRANSLATION = "project string, language string, cue_id string, text string, source_text string, version int, model_digest string, source_signature string"
JOB = "id string, project string, kind string, status string, stage string, progress double, message string, created double, updated double"


class Conflict(RuntimeError):
    """Another writer claimed the version first."""


def _json(spark: SparkSession, fs, path):
    """What a small file holds; None while it is empty or half written."""
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except (ValueError, Py4JJavaError):
        return None
    finally:
        stream.close()


class Store:
    """Tables below ``root``, on any file system that Spark writes.

    A table has numbered versions. Each names a manifest: which partition's rows lie in which
    snapshot. Readers take the newest version; a writer that breaks off leaves it in force. A
    version that stays empty for ``patience`` seconds is taken as broken off.
    """

    def __init__(self, spark: SparkSession, root: str, patience: float = 10.0):
        self.spark, self.root, self.patience = spark, root.rstrip("/"), patience

    # ---- versions

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        folder, fs = self._fs(f"{self.root}/{name}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def _content(self, name: str, number: int) -> dict | None:
        path, fs = self._fs(f"{self.root}/{name}/versions/{number:012d}")
        return _json(self.spark, fs, path)

    def newest(self, name: str) -> tuple[int, dict | None]:
        """Number of the last claimed version, and the newest content; (-1, None) for a table that isn't there."""
        until = time.monotonic() + self.patience
        while True:
            numbers = self._numbers(name)
            if not numbers:
                return -1, None
            content = self._content(name, numbers[-1])
            if content is not None:
                return numbers[-1], content
            if time.monotonic() >= until:  # broken off: the last whole one counts
                return numbers[-1], next((c for n in reversed(numbers[:-1]) if (c := self._content(name, n)) is not None), None)
            time.sleep(0.05)

    def _claim(self, name: str, number: int, content: dict) -> None:
        path, fs = self._fs(f"{self.root}/{name}/versions/{number:012d}")
        fs.mkdirs(path.getParent())
        try:
            if fs.getUri().getScheme() == "file":  # here Hadoop's exclusive creation looks first and creates then
                files, target = self.spark._jvm.java.nio.file.Files, self.spark._jvm.java.io.File(path.toUri().getPath()).toPath()
                files.createFile(target, self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                fs.create(path, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"{name} {number}") from None
            raise
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    # ---- rows

    def _manifest(self, name: str, content: dict) -> DataFrame:
        return self.spark.read.schema("value string, _snapshot string").parquet(f"{self.root}/{name}/manifests/{content['manifest']}")

    def _rows(self, name: str, schema: str, content: dict | None) -> DataFrame:
        if content is None:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{name}/data"
        folders = [f"{base}/_snapshot={s}" for s in content["snapshots"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        names = T._parse_datatype_string(schema).names
        rows = self.spark.read.schema(f"{schema}, _snapshot string").option("basePath", base).parquet(*folders)
        if content["column"]:
            # the manifest prunes partitions that a newer snapshot has replaced
            now = self._manifest(name, content).withColumnsRenamed({"value": "_value", "_snapshot": "_from"})
            rows = rows.join(now, F.col(content["column"]).cast("string").eqNullSafe(F.col("_value")) & (F.col("_snapshot") == F.col("_from")), "left_semi")
        return rows.select(*names)

    def read(self, name: str, schema: str) -> DataFrame:
        return self._rows(name, schema, self.newest(name)[1])

    def _write(self, name: str, rows: DataFrame, column: str | None, order: list[str] | None) -> str:
        snapshot = uuid.uuid4().hex
        out = rows.sortWithinPartitions(*[c for c in ([column] if column else [])], *order) if order else rows
        (out.write.partitionBy(column) if column else out.write).parquet(f"{self.root}/{name}/data/_snapshot={snapshot}")
        return snapshot

    def _commit(self, name: str, number: int, column: str | None, manifest: DataFrame) -> None:
        folder = uuid.uuid4().hex
        manifest.write.parquet(f"{self.root}/{name}/manifests/{folder}")
        kept = self.spark.read.schema("value string, _snapshot string").parquet(f"{self.root}/{name}/manifests/{folder}")
        # a snapshot is named once for each write that still has rows in force
        snapshots = sorted(r[0] for r in kept.select("_snapshot").distinct().collect())
        self._claim(name, number, {"manifest": folder, "column": column, "snapshots": snapshots})

    def _values(self, name: str, snapshot: str, column: str | None) -> DataFrame:
        if not column:
            return self.spark.createDataFrame([(None, snapshot)], "value string, _snapshot string")
        rows = self.spark.read.schema(f"{column} string").option("basePath", f"{self.root}/{name}/data/_snapshot={snapshot}").parquet(f"{self.root}/{name}/data/_snapshot={snapshot}")
        return rows.select(F.col(column).alias("value")).distinct().withColumn("_snapshot", F.lit(snapshot))

    def write(self, name: str, rows: DataFrame, partition: list[str] | None = None, order: list[str] | None = None) -> None:
        """The whole table anew, whatever others wrote meanwhile. Rows of a partition lie together and in order, so that readers of one project or time range skip the rest."""
        column = partition[0] if partition else None
        manifest = self._values(name, self._write(name, rows, column, order), column)
        while True:
            with contextlib.suppress(Conflict):
                return self._commit(name, self.newest(name)[0] + 1, column, manifest)

    def change(self, name: str, schema: str, f: Callable[[DataFrame], DataFrame], partition: list[str] | None = None, order: list[str] | None = None, tries: int = 20) -> None:
        """The table becomes ``f`` of itself. If another writer was faster, ``f`` runs again on what they wrote."""
        column = partition[0] if partition else None
        for _ in range(tries):
            number, content = self.newest(name)
            manifest = self._values(name, self._write(name, f(self._rows(name, schema, content)), column, order), column)
            with contextlib.suppress(Conflict):
                return self._commit(name, number + 1, column, manifest)
        raise Conflict(f"{name}: {tries} tries")

    def change_partitions(self, name: str, schema: str, column: str, values: list, f: Callable[[DataFrame], DataFrame], order: list[str] | None = None, tries: int = 20) -> None:
        """Only the partitions of ``values`` are read, changed by ``f`` and written; all others stay where they lie.

        ``f`` must return rows of these partitions alone; one without rows is gone. If another
        writer was faster and touched none of them, their change and this one both stand;
        otherwise ``f`` runs again.
        """
        wanted = self.spark.createDataFrame([(None if v is None else str(v),) for v in values], "value string")
        mine = F.col("value").eqNullSafe(F.col("_v"))
        base, snapshot = None, None
        for _ in range(tries):
            number, content = self.newest(name)
            if content is not None and content["column"] != column:
                raise ValueError(f"{name} is not partitioned by {column}")
            now = self._manifest(name, content) if content else self.spark.createDataFrame([], "value string, _snapshot string")
            touched = {(r[0], r[1]) for r in now.join(F.broadcast(wanted.withColumnRenamed("value", "_v")), mine, "left_semi").collect()}
            if snapshot is None or touched != base:
                rows = self._rows(name, schema, content)
                asked = F.broadcast(wanted.withColumnRenamed("value", "_v"))
                own = rows.join(asked, F.col(column).cast("string").eqNullSafe(F.col("_v")), "left_semi")
                base, snapshot = touched, self._write(name, f(own), column, order)
            rest = now.join(F.broadcast(wanted.withColumnRenamed("value", "_v")), mine, "left_anti")
            made = self._values(name, snapshot, column)
            if made.join(F.broadcast(wanted.withColumnRenamed("value", "_v")), mine, "left_anti").take(1):
                raise ValueError("rows of other partitions than asked for")
            with contextlib.suppress(Conflict):
                return self._commit(name, number + 1, column, rest.unionByName(made))
        raise Conflict(f"{name}: {tries} tries")

    def clean(self, name: str, keep: int = 2) -> int:
        """Deletes snapshots and manifests that none of the last ``keep`` versions names; returns how many snapshots. Not while others write."""
        contents = [c for n in self._numbers(name)[-keep:] if (c := self._content(name, n))]
        there = {f"_snapshot={s}" for c in contents for s in c["snapshots"]}, {c["manifest"] for c in contents}
        gone = 0
        for part, keepers in zip(("data", "manifests"), there):
            folder, fs = self._fs(f"{self.root}/{name}/{part}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                if s.getPath().getName() not in keepers:
                    fs.delete(s.getPath(), True)
                    gone += part == "data"
        return gone


class Results:
    """Tables that are computed once for each set of metadata: the marker, written last, says of what a folder is the result."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def get(self, kind: str, metadata: dict, make: Callable[[], DataFrame], rows: int | None = None) -> DataFrame:
        """The table of ``metadata`` (what it was made from, and how); ``make`` is called only if there is none.

        Without its marker, or with another one, a folder counts as partial and is written anew.
        ``rows`` is what the result must have: another number fails, and no marker is written.
        """
        text = json.dumps(metadata, sort_keys=True)
        folder = f"{self.root}/{kind}/{hashlib.sha256(text.encode()).hexdigest()}"
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/marker.json")
        fs = marker.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not (fs.exists(marker) and _json(self.spark, fs, marker) == json.loads(text)):
            fs.delete(marker, False)
            made = make()
            made.write.mode("overwrite").parquet(f"{folder}/rows")
            if rows is not None and (n := self.spark.read.parquet(f"{folder}/rows").count()) != rows:
                raise ValueError(f"{kind} has {n} rows instead of {rows}")
            stream = fs.create(marker, True)
            stream.write(bytearray(text.encode()))
            stream.close()
        return self.spark.read.parquet(f"{folder}/rows")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old rows whose key isn't among them. Keys are unique in ``new``; null keys never match."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_cues(old: DataFrame, new: DataFrame) -> DataFrame:
    """The tracks that ``new`` holds are replaced; cues that were edited or reviewed keep the user's text, times and marks. Other tracks stay."""
    mine = ["text", "start", "end", "reviewed", "edited"]
    before = old.select("project", "track", "id", *[F.col(c).alias(f"old_{c}") for c in mine])
    touched = F.coalesce(F.col("old_edited") | F.col("old_reviewed"), F.lit(False))
    merged = new.join(before, ["project", "track", "id"], "left").select(*[F.when(touched, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) if c in mine else F.col(c) for c in new.columns])
    tracks = new.select("project", "track").distinct()
    return merged.unionByName(old.join(tracks, ["project", "track"], "left_anti"), allowMissingColumns=True)


def checked(cues: DataFrame) -> DataFrame:
    """Cues with some text and an end after their start; a row that hasn't fails the job, whichever columns are read later."""
    good = (F.length(F.trim("text")) > 0) & (F.col("end") > F.col("start"))
    wrong = F.raise_error(F.concat(F.lit("invalid cue "), F.coalesce("id", F.lit("?")))).cast("boolean")
    return cues.filter(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(wrong))


def update_cues(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial updates (id, text, start, end, reviewed; null: unchanged) with the invariants of :func:`checked`."""
    c = changes.select("id", *[F.col(x).alias(f"new_{x}") for x in ("text", "start", "end", "reviewed")], F.lit(True).alias("hit"))
    joined = old.join(c, "id", "left")
    touched = F.col("new_text").isNotNull() | F.col("new_start").isNotNull() | F.col("new_end").isNotNull()
    made = {x: F.coalesce(f"new_{x}", x).alias(x) for x in ("text", "start", "end", "reviewed")} | {"edited": (F.col("edited") | touched).alias("edited")}
    return checked(joined.select(*[made.get(x, F.col(x)) for x in old.columns]))


def latest(log: DataFrame, keys: list[str], value: Column, order: Column, name: str = "last") -> DataFrame:
    """Last state per key of an append-only log."""
    return log.groupBy(*keys).agg(F.max_by(value, order).alias(name))


def after_restart(jobs: DataFrame) -> DataFrame:
    """Jobs that a stopped process left active become paused."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running", "pausing"), "paused").otherwise(F.col("status")))


def create_project(projects: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by fingerprint: a known file keeps its id, creation time and audio tracks."""
    kept = projects.select("fingerprint", F.col("id").alias("old_id"), F.col("created").alias("old_created"), F.col("audio_tracks").alias("old_audio"))
    merged = new.join(kept, "fingerprint", "left").select(
        F.coalesce("old_id", "id").alias("id"), "fingerprint", "name", F.coalesce("old_created", "created").alias("created"), F.coalesce("old_audio", "audio_tracks").alias("audio_tracks")
    )
    return upsert(projects, merged, ["fingerprint"])


def migrate(cues: DataFrame) -> DataFrame:
    """Old cue bodies: retired fields go, a renamed flag is rewritten in place, missing marks get their defaults."""
    out = cues.drop("speaker", "quality")
    if "flags" in out.columns:
        out = out.withColumn("flags", replaced(F.col("flags"), "Check translation", "Check wording"))
    for name in ("reviewed", "edited"):
        out = out.withColumn(name, F.coalesce(name, F.lit(False))) if name in out.columns else out.withColumn(name, F.lit(False))
    return out


def still_cached(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cache entries (key, size, metadata struct) that are whole and made from the same metadata."""
    w = wanted.select("key", F.col("metadata").alias("want"), F.col("size").alias("bytes"))
    return cache.join(w, "key").filter(F.col("metadata").eqNullSafe(F.col("want")) & (F.col("size") == F.col("bytes"))).select(*cache.columns)


def missing_work(wanted: DataFrame, done: DataFrame, key: str = "signature") -> DataFrame:
    """Work whose signature isn't done yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Projects whose file changed or went: the fingerprint of now isn't the stored one."""
    now = current.select("path", F.col("fingerprint").alias("now"))
    return stored.join(now, "path", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("now"))).select(*stored.columns)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
