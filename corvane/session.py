"""Letting Python workers import this package."""

from __future__ import annotations

import math
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, unless it is on their path already."""
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    package = Path(__file__).resolve().parent.name
    target = Path(tempfile.mkdtemp(prefix="corvane-")) / f"{package}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / package).rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one where Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corvane-"))
    return folder or context.getCheckpointDir()


def written(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder, for results that are read several times or must not be computed again."""
    shared(frame.sparkSession)
    return frame.checkpoint(eager=True)


def spread(frame: DataFrame, least: int = 1 << 20) -> DataFrame:
    """A scan dealt out over all cores where its files make fewer partitions, at ``least`` bytes each; else as it is."""
    spark = frame.sparkSession
    run = frame._jdf.queryExecution()
    wanted = min(spark.sparkContext.defaultParallelism, math.ceil(int(str(run.optimizedPlan().stats().sizeInBytes())) / least))
    return frame.repartition(wanted) if run.toRdd().getNumPartitions() < wanted else frame
