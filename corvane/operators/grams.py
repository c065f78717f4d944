"""A stored index of files by their runs of three characters, so that a search for a name reads the files that can have it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import code
from .keyword import light

#: Characters of a gram; up to so many candidate files are a condition on the stored files.
SIZE, FEW_FILES = 3, 1_000
#: Characters and files of a segment at most (a longer text is one of its own), and bytes of a row group.
PIECE, SEGMENT_FILES, GROUP_BYTES = 1 << 20, 2_048, 4 << 20


def grams_of(name: str) -> list[str]:
    """The distinct grams of a name."""
    return sorted({name[i : i + SIZE] for i in range(len(name) - SIZE + 1)})


def _inverted(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams in order, start of each one's texts, numbers of the texts): the grams of some texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    signs = np.flatnonzero(np.bincount(codes, minlength=1))
    sign = np.zeros(int(signs[-1]) + 1 if len(signs) else 1, np.int64)
    sign[signs] = np.arange(len(signs))
    whole = np.flatnonzero(of[: -SIZE + 1] == of[SIZE - 1 :]) if len(codes) >= SIZE else np.zeros(0, np.int64)
    dense, base = sign[codes], max(len(signs), 1)
    gram = np.zeros(len(whole), np.int64)
    for k in range(SIZE):
        gram = gram * base + dense[whole + k]
    kinds = None
    if base**SIZE * max(len(texts), 1) >= 1 << 63:
        kinds, gram = np.unique(gram, return_inverse=True)
    pairs = np.unique(gram * len(texts) + of[whole])
    gram, text = pairs // max(len(texts), 1), pairs % max(len(texts), 1)
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    held = gram[starts] if kinds is None else kinds[gram[starts]]
    parts = np.stack([signs[held // base**k % base] for k in reversed(range(SIZE))], axis=1) if len(held) else np.zeros((0, SIZE))
    joined = parts.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + SIZE] for i in range(0, len(joined), SIZE)], starts, text


def _segments(files: DataFrame) -> DataFrame:
    """(kind, gram, segment, docs, names): for each segment of some files a row of their names, and a row for each gram with the files' numbers."""
    ship(files.sparkSession)
    kind = files.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            size, cuts = 0, [0]
            for i, length in enumerate(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()):
                if i > cuts[-1] and (size + length > PIECE or i - cuts[-1] >= SEGMENT_FILES):
                    cuts.append(i)
                    size = 0
                size += length
            for start, stop in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                grams, starts, docs = _inverted([x or "" for x in batch.column(1).slice(start, stop - start).to_pylist()])
                n, names = len(grams), batch.column(0).slice(start, stop - start)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(docs)).astype(np.int32)), pa.array(docs.astype(np.int32)))
                held = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
                yield pa.RecordBatch.from_arrays([pa.array(["file"]), pa.nulls(1, pa.string()), pa.array([number]), pa.nulls(1, lists.type), held], names=["kind", "gram", "segment", "docs", "names"])
                yield pa.RecordBatch.from_arrays([pa.array(["gram"] * n, pa.string()), pa.array(grams, pa.string()), pa.array(np.full(n, number)), lists, pa.nulls(n, held.type)], names=["kind", "gram", "segment", "docs", "names"])
                number += 1

    return files.select("file", "text").mapInArrow(run, f"kind string, gram string, segment long, docs array<int>, names array<{kind}>")


def _named(places: DataFrame, names: DataFrame) -> DataFrame:
    """Places (segment, doc and more) with their files' names."""
    files = names.select("segment", F.posexplode("names").alias("doc", "file"))
    return files.join(light(places), ["segment", "doc"]).drop("segment", "doc")


def file_grams(files: DataFrame) -> DataFrame:
    """(gram, file): each gram that a file's text has."""
    rows = _segments(files)
    return _named(rows.where("kind = 'gram'").select("gram", "segment", F.explode("docs").alias("doc")), rows.where("kind = 'file'")).select("gram", "file")


@dataclass
class GramIndex:
    """Grams with numbers of files by segment, the files' names by segment, and the files, sorted by name."""

    grams: DataFrame
    names: DataFrame
    files: DataFrame

    @classmethod
    def write(cls, files: DataFrame, path: str) -> GramIndex:
        """Store the index of (file, text), and the files beside it. Null texts have no grams; names of files are taken to differ.

        Texts are cut up in arrays, and a gram is a row for each segment of files, not for each file. Grams are not shuffled:
        each task sorts its own, so that a search reads the row groups of a name's grams in each file.
        """
        spark = files.sparkSession
        _segments(files).sortWithinPartitions("kind", "gram", "segment").write.mode("overwrite").partitionBy("kind").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/grams")
        files.select("file", "text").repartitionByRange("file").sortWithinPartitions("file").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/files")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> GramIndex:
        """A stored index."""
        files = spark.read.parquet(f"{path}/files")
        rows = spark.read.schema(f"gram string, segment long, docs array<int>, names array<{files.schema['file'].dataType.simpleString()}>, kind string").parquet(f"{path}/grams")
        return cls(rows.where("kind = 'gram'").select("gram", "segment", "docs"), rows.where("kind = 'file'").select("segment", "names"), files)

    def candidates(self, name: str) -> DataFrame | None:
        """(file) of the files that have all grams of a name; None for a name too short to have any."""
        grams = grams_of(name)
        if not grams:
            return None
        some = self.grams.where(F.col("gram").isin(grams)).groupBy("segment").agg(F.collect_list("docs").alias("lists")).where(F.size("lists") == len(grams))
        met = F.aggregate("lists", F.col("lists")[0], F.array_intersect)
        return _named(some.select("segment", F.explode(met).alias("doc")), self.names).select("file")

    def texts(self, name: str) -> DataFrame:
        """(file, text) of the files that can have a name. Few of them are a condition on the sorted files, so other row groups
        are not read; building the frame counts them."""
        some = self.candidates(name)
        if some is None:
            return self.files
        few = [r["file"] for r in some.limit(FEW_FILES + 1).collect()]
        if len(few) <= FEW_FILES:
            return self.files.where(F.col("file").isin(few))
        return self.files.join(light(some), "file", "left_semi")

    def usages(self, name: str) -> DataFrame:
        """(file, line, text): the usages of a name, from the candidate files alone."""
        return code.usages(self.texts(name), name)
