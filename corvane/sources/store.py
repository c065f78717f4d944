"""Collections, files and versions: what the engine reads and writes."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BACKUPS, CHUNKS, LIMITS, SNAPSHOT
from ..functions import text as X
from .ledger import Ledger

#: Names of collections and the sources they hold.
COLLECTIONS = {"api": "api", "guides": "guide", "mods": "mod"}


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by source, so that a collection is a pruned partition."""
    chunks.write.mode("overwrite").partitionBy("source").parquet(path)


def collection(spark: SparkSession, path: str, name: str = "all") -> DataFrame:
    """The chunks of a collection, or all; under a root of versions those of the current one."""
    current = Ledger(spark, path).read()[1]["current"]
    chunks = spark.read.schema(CHUNKS).parquet(f"{path.rstrip('/')}/{current}" if current else path)
    return chunks if name == "all" else chunks.where(F.col("source") == COLLECTIONS[name])


def conditions(*parts: Column | None) -> Column:
    """All conditions that are given; none gives true."""
    out = F.lit(True)
    for p in parts:
        out = out if p is None else out & p
    return out


def get(
    chunks: DataFrame, ids: list[str] | None = None, where: dict[str, str] | None = None, prefix: dict[str, str] | None = None, limit: int | None = None,
    isin: dict[str, list] | None = None, differs: dict[str, object] | None = None, at_least: dict[str, object] | None = None, below: dict[str, object] | None = None, offset: int = 0,
) -> DataFrame:
    """Chunks by id, values, lists of values, prefixes and ranges, in order of id if limited. Conditions reach the scan.

    A missing value counts as the empty text: it equals '', and differs from all else.
    """
    parts = [F.col("chunk_id").isin(ids)] if ids else []
    parts += [(F.col(k) == v) if v != "" else (F.col(k).isNull() | (F.col(k) == "")) for k, v in (where or {}).items()]
    parts += [F.col(k).startswith(v) for k, v in (prefix or {}).items()]
    parts += [F.col(k).isin(list(v)) for k, v in (isin or {}).items()]
    parts += [(F.col(k).isNull() | (F.col(k) != v)) if v != "" else (F.col(k) != "") for k, v in (differs or {}).items()]
    parts += [F.col(k) >= v for k, v in (at_least or {}).items()]
    parts += [F.col(k) < v for k, v in (below or {}).items()]
    found = chunks.where(conditions(*parts))
    if limit is None and not offset:
        return found
    ordered = found.orderBy("chunk_id").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def with_bodies(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows with the body of their chunk_id from (chunk_id, body), '' where there is none; a lost body loses no row."""
    return rows.drop("body").join(bodies.select("chunk_id", "body"), "chunk_id", "left").withColumn("body", F.coalesce("body", F.lit("")))


def files_by_folder(files: DataFrame) -> DataFrame:
    """(folder, files): how many files of (file) lie under each first folder of their path."""
    folder = F.regexp_extract("file", r"^(?:[a-z]+://)?/*([^/]+)/", 1)
    return files.where(folder != "").groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def chunk_windows(texts: DataFrame, size: int = LIMITS.chunk_chars, overlap: int = LIMITS.chunk_overlap) -> DataFrame:
    """(id, chunk_no, body) of (id, text): windows of ``size`` characters, each ``overlap`` into the one before."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - overlap) / F.lit(step)) - 1, F.lit(0)).cast("int")
    numbered = texts.where(F.length("text") > 0).select("id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return numbered.select("id", "chunk_no", F.substr("text", F.col("chunk_no") * step + 1, F.lit(size)).alias("body"))


def source_files(spark: SparkSession, root: str, glob: str = "*.java") -> DataFrame:
    """(file, text) of all files under a folder; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def skills(spark: SparkSession, root: str) -> DataFrame:
    """(name, files, has_skill): the markdown files of each folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root).select("path")
    inner = F.regexp_extract("path", rf".*{_quoted(root.rstrip('/'))}/([^/]+)/(.*)", 1)
    rest = F.regexp_extract("path", rf".*{_quoted(root.rstrip('/'))}/([^/]+)/(.*)", 2)
    grouped = files.select(inner.alias("name"), rest.alias("file")).where("name <> ''").groupBy("name").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return grouped.withColumn("has_skill", F.array_contains("files", "SKILL.md"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON file of any layout, with a stated schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def folder_mb(spark: SparkSession, root: str) -> float:
    """Size of all files under a folder in MB, to one digit."""
    size = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).agg(F.sum("length")).first()[0]
    return round((size or 0) / 2**20, 1)


class Versions:
    """Versioned tables under one root: snapshots and backups are new folders, and numbered commits say which is current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.ledger = spark, root.rstrip("/"), Ledger(spark, root)

    def backup(self, table: DataFrame, label: str = "", meta: dict | None = None, current: bool = False) -> str:
        """Write a table as a new version; the name has the time, the label and a unique end.

        The version and its record, with the metadata (else what is in force), appear in one commit; with ``current`` the
        version is what ``collection`` reads from then on. Tables with a source lie by source.
        """
        now = datetime.now(UTC)
        clean = self.spark.range(1).select(X.clean_label(F.lit(label))).first()[0]
        name = "_".join(x for x in ("backup", now.strftime("%Y%m%d_%H%M%S"), clean, uuid.uuid4().hex[:6]) if x)
        by = ["source"] if "source" in table.columns and len(table.columns) > 1 else []
        table.write.partitionBy(*by).parquet(f"{self.root}/{name}")
        count, size = self.spark.read.schema(table.schema).parquet(f"{self.root}/{name}").count(), folder_mb(self.spark, f"{self.root}/{name}")
        record = {"file": name, "count": count, "label": label, "created_at": now.isoformat(), "size_mb": size, "schema": table.schema.json()}

        def add(state: dict) -> dict:
            held = state["meta"] if meta is None else meta
            state["records"].append(record | {"meta": held})
            return state | ({"current": name, "meta": held} if current else {})

        self.ledger.commit(add)
        return name

    def list(self) -> DataFrame:
        """Backups that are there, newest first."""
        path, files = self._path("")
        there = {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()
        rows = [tuple(r[f.name] for f in BACKUPS.fields) for r in self.ledger.read()[1]["records"] if r["file"] in there]
        return self.spark.createDataFrame(rows, BACKUPS).orderBy(F.desc("created_at"), F.desc("file"))

    def _record(self, state: dict, name: str) -> dict:
        found = next((r for r in state["records"] if r["file"] == name), None)
        if found is None or not self._exists(name):
            raise ValueError(f"no backup {name}")
        return found

    def restore(self, name: str) -> DataFrame:
        """Make a version, and its metadata, the current one, in one commit; nothing is copied. Returns its table."""

        def switch(state: dict) -> dict:
            return state | {"current": name, "meta": self._record(state, name)["meta"]}

        self.ledger.commit(switch)
        return self.current()

    def current(self) -> DataFrame | None:
        """The table of the current version; None where none has been made current."""
        state = self.ledger.read()[1]
        if not state["current"]:
            return None
        schema = T.StructType.fromJson(json.loads(self._record(state, state["current"])["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{state['current']}")

    def meta(self) -> dict:
        """The metadata in force."""
        return self.ledger.read()[1]["meta"]

    def update_meta(self, key: str, value: object) -> None:
        """Set one key of the metadata; other writers' keys stay."""
        self.ledger.commit(lambda state: state | {"meta": state["meta"] | {key: value}})

    def delete(self, name: str) -> bool:
        """Delete a version and its record; the current one stays."""
        if not name or "/" in name or name.startswith(".") or not self._exists(name):
            return False
        if self.ledger.read()[1]["current"] == name:
            return False
        self.ledger.commit(lambda state: state | {"records": [r for r in state["records"] if r["file"] != name]})
        path, files = self._path(name)
        return bool(files.delete(path, True))

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._path(name)
        return bool(name) and files.exists(path)

    def rotate(self, snapshot: DataFrame) -> None:
        """A new current snapshot; the one before stays as the previous, older ones go."""
        numbers = self._numbers()
        number = max(numbers, default=0) + 1
        snapshot.write.parquet(f"{self.root}/snapshot/v={number}")
        for old in sorted(numbers)[:-1]:
            path, files = self._path(f"snapshot/v={old}")
            files.delete(path, True)

    def _numbers(self) -> list[int]:
        path, files = self._path("snapshot")
        return [int(s.getPath().getName()[2:]) for s in files.listStatus(path)] if files.exists(path) else []

    def snapshots(self) -> tuple[DataFrame | None, DataFrame | None]:
        """(previous, current); None where there is none."""
        numbers = sorted(self._numbers())
        read = lambda n: self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/snapshot/v={n}")
        return (read(numbers[-2]) if len(numbers) > 1 else None), (read(numbers[-1]) if numbers else None)

    def save_diff(self, found: DataFrame, text: str) -> None:
        """Write differences and their summary; the latest stands alone."""
        found.write.mode("overwrite").parquet(f"{self.root}/diff")
        row = [(text, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))]
        self.spark.createDataFrame(row, "summary string, diffed_at string").coalesce(1).write.mode("overwrite").json(f"{self.root}/diff_summary")

    def last_diff(self) -> dict | None:
        """The latest differences' summary, or None."""
        path, files = self._path("diff_summary")
        if not files.exists(path):
            return None
        return json.loads(self.spark.read.schema("summary string, diffed_at string").json(str(path)).toJSON().first())


def status(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """(collection, chunks, indexed, indexed_at, embed_model, repo_count) of each collection of the metadata."""
    live = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("live"))
    joined = meta.join(live, F.col("collection") == F.col("source"), "left")
    n = F.coalesce("live", F.lit(0)).cast("long")
    return joined.select("collection", n.alias("chunks"), (n > 0).alias("indexed"), "indexed_at", "embed_model", "repo_count")


def tier_assets(assets: DataFrame, prefix: str, tier: str) -> DataFrame:
    """Release files of a tier: names with the prefix, without vectors for the lite one."""
    named = assets.where(F.col("name").startswith(prefix))
    return named.where(~F.col("name").contains("-vectors-")) if tier == "lite" else named


def jobs_shown(jobs: DataFrame, recent: int = 5) -> DataFrame:
    """Jobs that run, and the last few that ended."""
    ended = F.col("status").isin("done", "failed")
    return jobs.where(~ended).unionByName(jobs.where(ended).orderBy(F.desc("started_at"), F.desc("job_id")).limit(recent))


def log_tail(logs: DataFrame, n: int = 500) -> DataFrame:
    """The last n log rows by time."""
    return logs.orderBy(F.desc("time"), F.desc("log_id")).limit(n)
