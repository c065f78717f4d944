"""Snapshots of an API and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions import text as X

#: Up to so many changed groups are a condition on the scans of both snapshots.
FEW_GROUPS = 1_000
NO_SNAPSHOT = "No previous snapshot to compare with."


def snapshot(chunks: DataFrame) -> DataFrame:
    """(fqn, class_name, package, extends, implements, methods, fields) from overviews and methods; of several overviews the one of greatest id."""
    api = chunks.where(F.coalesce("fqn", F.lit("")) != "")
    keep = ("class_name", "package", "extends", "implements")
    latest = api.where(F.col("type") == "class_overview").groupBy("fqn").agg(F.max_by(F.struct(*keep, "body"), "chunk_id").alias("c"))
    classes = latest.select("fqn", *[F.coalesce(f"c.{k}", F.lit("")).alias(k) for k in keep], X.fields_of(F.coalesce("c.body", F.lit(""))).alias("fields"))
    methods = sets(api.where((F.col("type") == "method") & (F.coalesce("method_name", F.lit("")) != "")), "fqn", "method_name", "methods")
    empty = F.array().cast("array<string>")
    return classes.join(methods, "fqn", "left").select("fqn", *keep, F.coalesce("methods", empty).alias("methods"), F.sort_array("fields").alias("fields"))


def sets(rows: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """The distinct sorted members of each key."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(member)).alias(name))


def _some(label: str, items: Column, shown: int = LIMITS.changes_shown) -> Column:
    """'label: a, b (and n more)' of a list that is not empty, else null."""
    tail = F.when(F.size(items) > shown, F.concat(F.lit("... and "), (F.size(items) - shown).cast("string"), F.lit(" more")))
    return F.when(F.size(items) > 0, F.concat(F.lit(label + ": "), F.concat_ws(", ", F.slice(items, 1, shown), tail)))


def digests(snapshot: DataFrame, group: str = "package") -> DataFrame:
    """(group, members, digest) of each group of a snapshot: sums of the digests of its rows, which no order of rows changes."""
    rows = snapshot.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias(group), F.xxhash64(*[F.col(c) for c in sorted(snapshot.columns)]).alias("d"))
    wide = F.col("d").cast("decimal(38,0)")
    mixed = F.xxhash64("d", F.lit(1)).cast("decimal(38,0)")
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.struct(F.sum(wide).alias("one"), F.sum(mixed).alias("two")).alias("digest"))


def changed_groups(old: DataFrame, new: DataFrame, group: str = "package") -> DataFrame:
    """(group) of the groups whose digests differ, or that only one side has."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{group}") == F.col(f"n.{group}"), "full_outer")
    same = F.col("o.members").eqNullSafe(F.col("n.members")) & F.col("o.digest").eqNullSafe(F.col("n.digest"))
    return both.where(~same).select(F.coalesce(f"n.{group}", f"o.{group}").alias(group))


def changed_rows(old: DataFrame, new: DataFrame, group: str = "package", known: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both snapshots without the groups that did not change: one row a group is compared before any member is joined.

    ``known`` are digests that were stored with the snapshots. Up to FEW_GROUPS changed groups are a condition on the scans;
    building the frames compares the digests.
    """
    one, two = known or (digests(old, group), digests(new, group))
    groups = [r[group] for r in changed_groups(one, two, group).limit(FEW_GROUPS + 1).collect()]
    key = F.coalesce(F.col(group).cast("string"), F.lit(""))
    if len(groups) <= FEW_GROUPS:
        plain = F.col(group).isin(groups) | (F.col(group).isNull() if "" in groups else F.lit(False))
        return old.where(plain), new.where(plain)
    some = changed_groups(one, two, group).withColumnRenamed(group, "__group")
    return tuple(d.join(some, key == F.col("__group"), "left_semi") for d in (old, new))


def differences(old: DataFrame, new: DataFrame, key: str = "fqn", scalars: tuple[str, ...] = ("extends", "implements"), lists: tuple[str, ...] = ("methods", "fields")) -> DataFrame:
    """(key, kind, changes): keys added, removed or modified between two snapshots; unchanged ones are left out.

    One full outer join on the key. Changes come in a fixed order: scalars, then each list's additions and removals.
    """
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    empty = F.array().cast("array<string>")
    parts = [F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.concat(F.lit(f"{c}: "), F.coalesce(f"o.{c}", F.lit("")), F.lit(" -> "), F.coalesce(f"n.{c}", F.lit("")))) for c in scalars]
    for c in lists:
        was, now = F.coalesce(f"o.{c}", empty), F.coalesce(f"n.{c}", empty)
        parts.append(_some(f"{c} added", F.sort_array(F.array_except(now, was))))
        parts.append(_some(f"{c} removed", F.sort_array(F.array_except(was, now))))
    kind = F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"n.{key}").isNull(), "removed").otherwise("modified")
    changes = F.when(kind == "modified", F.array_compact(F.array(*parts))).otherwise(empty)
    out = joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), kind.alias("kind"), changes.alias("changes"))
    return out.where((F.col("kind") != "modified") | (F.size("changes") > 0))


def summary(found: DataFrame, key: str = "fqn") -> DataFrame:
    """One row: counts by kind, and up to twenty keys of each kind, sorted, as text. Keys beyond are counted, not gathered."""
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    kinds = ("added", "removed", "modified")
    totals = found.agg(*[count(k).alias(k) for k in kinds])
    named = found.select("kind", F.col(key).cast("string").alias("__key"))
    first = named.withColumn("__rn", F.row_number().over(Window.partitionBy("kind").orderBy("__key"))).where(F.col("__rn") <= LIMITS.classes_shown)
    listed = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("__key"))))
    one = totals.join(F.broadcast(first.agg(*[listed(k).alias(f"{k}_shown") for k in kinds])))
    text = F.concat_ws("\n", *[F.when(F.col(k) > 0, F.concat(F.lit(f"{k} ("), F.col(k).cast("string"), F.lit("): "), F.concat_ws(", ", f"{k}_shown"))) for k in kinds])
    return one.select(*kinds, F.when(text == "", F.lit("No changes.")).otherwise(text).alias("summary"))


def compared(old: DataFrame | None, new: DataFrame) -> tuple[DataFrame | None, str]:
    """(differences, summary text) of a snapshot and the one before; without one there are none, and the text says so."""
    if old is None:
        return None, NO_SNAPSHOT
    found = differences(*changed_rows(old, new))
    return found, summary(found).first()["summary"]
