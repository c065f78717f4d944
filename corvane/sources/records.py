"""Small records beside the tables: index metadata, versions, release files, skills."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

RELEASE = "tag_name string, published_at string, assets array<struct<name:string,size:bigint,browser_download_url:string>>"


def merge_meta(meta: DataFrame, changed: DataFrame) -> DataFrame:
    """Metadata with the changed collections' rows in place of the old ones."""
    return meta.join(changed.select("collection"), "collection", "left_anti").unionByName(changed, allowMissingColumns=True)


def version_record(spark: SparkSession, tag: str, tier: str, published_at: str | None = None) -> DataFrame:
    """One row: tag, tier, when it was published and when it was fetched."""
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return spark.createDataFrame([(tag, tier, published_at, now)], "tag string, tier string, published_at string, downloaded_at string")


def release_assets(spark: SparkSession, path: str) -> DataFrame:
    """(tag, name, size, browser_download_url) of a saved release listing."""
    listing = spark.read.schema(RELEASE).option("multiLine", "true").json(path)
    return listing.select(F.col("tag_name").alias("tag"), F.explode("assets").alias("a")).select("tag", "a.*")


def skill_name(name: str) -> str:
    """Lower-case letters, digits, '-' and '_' of a name; '' if none is left."""
    return "".join(c for c in name.lower() if c.isalnum() or c in "-_")


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_skill(spark: SparkSession, root: str, name: str, text: str) -> str:
    """Write a skill's file under its clean name, which is returned."""
    clean = skill_name(name)
    if not clean:
        raise ValueError("a skill needs a name")
    path, files = _files(spark, f"{root}/{clean}/SKILL.md")
    out = files.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()
    return clean


def read_skill(spark: SparkSession, root: str, name: str) -> str | None:
    """A skill's text, or None."""
    path, files = _files(spark, f"{root}/{skill_name(name)}/SKILL.md")
    return spark.read.text(str(path), wholetext=True).first()[0] if skill_name(name) and files.exists(path) else None


def delete_skill(spark: SparkSession, root: str, name: str) -> bool:
    """Delete the folder of a clean name directly under the root; nothing else can be reached."""
    clean = skill_name(name)
    if not clean or clean != PurePosixPath(clean).name:
        return False
    path, files = _files(spark, f"{root}/{clean}")
    return bool(files.exists(path) and files.delete(path, True))


def valid_project_name(name: DataFrame | str):
    """A cleaned project name and whether it may be used: it begins with a capital."""
    clean = X.clean_name(F.col(name) if isinstance(name, str) else name)
    return clean, clean.rlike("^[A-Z]")
