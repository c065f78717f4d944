"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text that a Python worker holds as objects at one time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs in one process (tests, a laptop) a temporary folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corvane-"))
    return folder or context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Rows whose decisions one bitmap holds (Spark's own size, 4 kB), and bitmaps that one broadcast holds at most (32 MB).
SLICE_ROWS, BLOCK_SLICES = 32_768, 8_192


def filed(frame: DataFrame) -> DataFrame:
    """The frame if it is a plain scan of Parquet files, else a copy of it in the shared folder, read again.

    Rows of a plain scan are known by their file and their place in it, however often it is read.
    """
    plan = frame._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and "Parquet" in plan.relation().fileFormat().toString():
        return frame
    path = f"{shared_folder(frame.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> bool:
    """Delete the copy that ``filed`` wrote, if the frame is a plain scan of one; nothing else is ever deleted.

    For copies that no frame still to be computed reads.
    """
    spark = frame.sparkSession
    plan = frame._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    paths = plan.relation().location().rootPaths()
    if paths.size() != 1 or not re.fullmatch(r"rows-[0-9a-f]{32}", paths.head().getName()):
        return False
    path = paths.head()
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    home = files.makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark)))
    return files.makeQualified(path.getParent()).equals(home) and bool(files.delete(path, True))


def located(frame: DataFrame, *columns: str) -> DataFrame:
    """Some columns of a plain scan, with __file, a hash of each row's file, and __at, its place there."""
    about = frame.metadataColumn("_metadata")
    return frame.select(*columns, F.xxhash64(about["file_path"]).alias("__file"), about["row_index"].alias("__at"))


def decided(frame: DataFrame, decisions: DataFrame, most: int) -> DataFrame:
    """(__all, __n): the rows of a plain scan as structs, with their decisions (__file, __at, n), n from 0 to ``most``, 0 where there is none.

    No row of the frame is moved: decisions are packed into bitmaps, a bit or two a row, which are broadcast to the scan
    of the files that they are of, at most BLOCK_SLICES bitmaps to one scan. More files make more such scans, each over
    its own files. Decisions should be cheap to read again. Building the frame runs two small jobs.
    """
    bits = most.bit_length()
    packed = decisions.where(F.col("n") > 0).withColumn("__slice", F.floor(F.col("__at") / SLICE_ROWS)).withColumn("__bit", F.col("__at") % SLICE_ROWS)
    held = packed.groupBy("__file", "__slice").agg(*[F.bitmap_construct_agg(F.when(F.col("n").bitwiseAND(1 << k) > 0, F.col("__bit"))).alias(f"__b{k}") for k in range(bits)])
    held = cut(held)
    blocks = max(1, math.ceil(1.25 * held.count() / BLOCK_SLICES))
    out = None
    for block in range(blocks):
        mine = F.pmod(F.col("__file"), F.lit(blocks)) == block
        about, everything = frame.metadataColumn("_metadata"), F.struct(*[F.col(f"`{c}`") for c in frame.columns])
        rows = frame.select(everything.alias("__all"), F.xxhash64(about["file_path"]).alias("__file"), about["row_index"].alias("__at"))
        rows = rows.withColumn("__slice", F.floor(F.col("__at") / SLICE_ROWS))
        rows = (rows.where(mine) if blocks > 1 else rows).join(F.broadcast(held.where(mine)), ["__file", "__slice"], "left")
        at = (F.col("__at") % SLICE_ROWS).cast("int")

        def bit(k: int, at: Column = at) -> Column:
            byte = F.conv(F.hex(F.substr(F.col(f"__b{k}"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.coalesce(F.getbit(byte, at % 8).cast("int") * (1 << k), F.lit(0))

        value = bit(0)
        for k in range(1, bits):
            value = value + bit(k)
        part = rows.select("__all", value.alias("__n"))
        out = part if out is None else out.unionByName(part)
    return out


def running(frame: DataFrame, order: list[Column], sums: dict[str, Column], rows_a_task: int = 100_000) -> DataFrame:
    """The frame with running sums, each row's own value included, over all rows in an order that no two rows share.

    Rows are dealt out by ranges, so no task holds all; one row of sums for each range reaches the driver.
    """
    spark = frame.sparkSession
    ranges = max(1, math.ceil(frame.count() / rows_a_task))
    parts = cut(frame.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    totals = parts.groupBy("__range").agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()]).collect()
    before, at = [], dict.fromkeys(sums, 0.0)
    for row in sorted(totals, key=lambda r: r["__range"]):
        before.append((row["__range"], *at.values()))
        at = {n: at[n] + (row[n] or 0.0) for n in sums}
    # As an Arrow table: rows of Python objects would start workers of another kind on every executor, which stay beside the operators' own.
    kinds = {"__range": pa.int32()} | {f"__{n}": pa.float64() for n in sums}
    starts = spark.createDataFrame(pa.table({n: pa.array([b[i] for b in before], t) for i, (n, t) in enumerate(kinds.items())}))
    window = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(starts), "__range").withColumns({n: F.col(f"__{n}") + F.sum(c).over(window) for n, c in sums.items()})
    return out.drop("__range", *[f"__{n}" for n in sums])


#: Keys of over this share of all rows are dealt out over so many parts.
HEAVY_SHARE, HEAVY_PARTS = 0.001, 32


def heavy_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """Join rows with a table that has one row for each key, where one key may hold a large share of the rows.

    ``weight`` of a right row is at least the number of left rows of its key. Keys of over HEAVY_SHARE of the weight, at
    most 1 / HEAVY_SHARE of them, are broadcast (the keys alone); their left rows are dealt out by a hash of the whole
    row, their right rows repeated for each part. ``how`` is inner or left. Both frames should be cheap to read again.
    Building the frame runs one aggregation, unless ``total``, the whole weight or more, is given. Null keys match nothing.
    """
    if total is None:
        total = right.agg(F.sum(weight)).first()[0] or 0
    is_heavy = F.col(weight) > F.lit(HEAVY_SHARE * float(total))
    heavy = right.where(is_heavy).select(*on, F.lit(True).alias("__heavy"))
    spread = left.withColumn("__part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(HEAVY_PARTS)).cast("int")).join(F.broadcast(heavy), on, "left")
    spread = spread.withColumn("__part", F.when(F.col("__heavy"), F.col("__part")).otherwise(F.lit(0))).drop("__heavy")
    parts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(HEAVY_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return spread.join(right.withColumn("__part", F.explode(parts)), [*on, "__part"], how).drop("__part")


#: Defaults of Spark's Arrow batches, and what the operators on texts use instead.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def prepare(spark: SparkSession) -> None:
    """Make the package known to the workers, and Arrow batches small unless the session has its own setting.

    The JVM holds the buffers of a batch outside its heap, and a worker holds a batch whole.
    """
    ship(spark)
    for key, (default, small) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, small)


def trim() -> None:
    """Give memory that a worker no longer uses back to the system: an idle worker shares its machine with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def rest(spark: SparkSession) -> None:
    """Have the executors collect their garbage and give free heap back to the system: what a stage of sorts has made of it stays else.

    For the time between stages, when all cores are idle: a small task on each asks its executor.
    """
    tasks = spark.sparkContext.defaultParallelism
    asked = spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("gc"))
    asked.write.format("noop").mode("overwrite").save()


_HELD: dict[object, object] = {}


def held(key: object, build: Callable[[], object]) -> object:
    """What a worker keeps for its next task, built once; a worker keeps one such thing, the last."""
    if key not in _HELD:
        release()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Give up what this worker kept of another operator: workers are used again, and what they keep counts beside what they do."""
    if _HELD:
        _HELD.clear()
        trim()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Yield (first row, texts as bytes) over a batch, about ``limit`` bytes at a time; null becomes b''."""
    values = batch.column(batch.schema.get_field_index(column))
    values = values.cast(pa.large_binary())
    start, size, out = 0, 0, []
    for i in range(len(values)):
        item = values[i].as_py() or b""
        out.append(item)
        size += len(item)
        if size >= limit:
            yield start, out
            start, size, out = i + 1, 0, []
    if out:
        yield start, out


def per_text(
    frame: DataFrame, keep: list[str], make: Callable[[], Callable[[list[bytes]], dict[str, list]]], fields: list[tuple[str, pa.DataType]], ddl: str, column: str = "text"
) -> DataFrame:
    """Map each row's text to new columns, in Arrow batches.

    ``make`` runs once in a worker and returns a function from a list of texts (bytes) to columns.
    Only ``keep`` and the text column reach Python; ``ddl`` names the new columns for Spark.
    """
    prepare(frame.sparkSession)
    source = frame.select(*keep, column)
    schema = ", ".join([f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep] + [ddl])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            at = 0
            for start, texts in slices(batch, column):
                at = start
                got = work(texts)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(k)) for k in keep] + [pa.array(got[n], t) for n, t in fields], names=keep + [n for n, _ in fields]
                )
        del work
        trim()

    return source.mapInArrow(run, schema)


def where_text(frame: DataFrame, make: Callable[[], Callable[[list[bytes]], list[bool]]], column: str = "text") -> DataFrame:
    """The rows, with all columns, whatever their names, whose text a worker's function keeps.

    A null text reaches the function as b''; repeated rows are judged row by row; an empty table stays empty.
    """
    prepare(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            for start, texts in slices(batch, column):
                yield batch.slice(start, len(texts)).filter(pa.array(work(texts), pa.bool_()))
        del work
        trim()

    return frame.mapInArrow(run, frame.schema)


def held_out(column: str, modulus: int) -> F.Column:
    """True where crc32 of the id as text leaves the remainder 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus) == 1, F.lit(False))
