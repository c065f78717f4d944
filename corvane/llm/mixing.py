"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words: shares by weight, none above a multiple of what the source has, the excess shared
again by weight. A document then stands for target / size copies, a whole number and a fraction. Fractions are rounded
in pairs: probability moves from one document to the other until one of them is whole, in a direction drawn so that each
document keeps its expectation, and by amounts inverse to the documents' sizes, so that the sum of words stays the same.
Blocks of a source are rounded on their own and leave one fraction each; these residuals meet, a few dozen at a time, in
a tree of further rounds. Documents meet from the longest on, so that what is left in the end is short: a source's words
differ from its target by less than one document, mostly a short one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, decided, filed, heavy_join, located, prepare, running

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 2_000
FAN_IN = 64
BROADCAST_SOURCES = 100_000
SALTS = 32


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns, source and size (words of the text; null: 0)."""
    return docs.select(*keep, F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame, limit: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, docs, source_size and target of each source.

    Sources in order of code points, null last, weigh 1, 2, 3, repeating. A source's target is min(limit * size,
    level * weight) with the level at which all targets make up the total: sources in order of limit * size / weight
    are full up to the one where the rest, shared by weight, would no longer fill the next.
    """
    by_source = cut(rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size")))
    one, name = F.lit(1.0), F.col("source").asc_nulls_last()
    ranked = running(by_source, [name], {"rank": one})
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = cut(ranked.withColumn("cap", F.col("source_size") * F.lit(float(limit))))
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    levels = cut(running(ranked, [(F.col("cap") / F.col("weight")).asc(), name], {"__caps": F.col("cap"), "__weights": F.col("weight")}))
    # The level that all sources from this one on would share if those before were full.
    level = (F.lit(float(whole["size"] or 0)) - (F.col("__caps") - F.col("cap"))) / (F.lit(float(whole["weight"] or 1)) - (F.col("__weights") - F.col("weight")))
    # The first source that its level does not fill sets the level of all after it: fullness grows along the order.
    first = levels.where(level * F.col("weight") < F.col("cap")).agg(F.min(F.struct((F.col("cap") / F.col("weight")).alias("full"), level.alias("level"))).alias("f")).first()["f"]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(float(first["level"])) * F.col("weight"))
    return levels.select("source", "docs", "source_size", target.alias("target"))


def pivot(x: np.ndarray, size: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Round fractions in pairs; at most one stays, and none if ``last``. Sizes are positive."""
    x = x.copy()
    draws = rng.random(len(x) + 1)
    held = -1
    for i in range(len(x)):
        if not 0.0 < x[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up = min(a * (1 - x[held]), b * x[i])  # words that may move to the held document
        down = min(a * x[held], b * (1 - x[i]))
        move = up if draws[i] < down / (up + down) else -down
        p, q = x[held] + move / a, x[i] - move / b
        near = lambda v: 0.0 if v < 1e-12 else 1.0 if v > 1 - 1e-12 else v
        x[held], x[i] = near(p), near(q)
        if 0.0 < x[i] < 1.0:
            held = i
        elif not 0.0 < x[held] < 1.0:
            held = -1
    if last and held >= 0:
        x[held] = float(draws[-1] < x[held])
    return x


def _round(frame: DataFrame, last: bool, seed: int) -> DataFrame:
    """One round of the tree: the rows of a (source, block) from the longest on, equal ones in an order drawn from their ids.

    Neighbours are then of like size, so either may stay open, and the one left at the end is a short one.
    """
    prepare(frame.sparkSession)
    schema = frame.schema

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "__order", "__key"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(pdf["__order"].iloc[0]) & 0x7FFFFFFFFFFFFFFF, len(pdf)])
        x = pdf["__x"].to_numpy(float)
        some = pdf["size"].to_numpy() > 0
        x[some] = pivot(x[some], pdf["size"].to_numpy(float)[some], rng, last)
        x[~some] = 0.0
        pdf["__x"] = x
        return pdf[[f.name for f in schema.fields]]

    return frame.groupBy("source", "__block").applyInPandas(work, schema)


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: int = 7, limit: float = 3.0, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN, by: tuple[str, ...] | None = None) -> DataFrame:
    """Decide how many copies of each row the mix takes.

    Returns ``keep``, source, size, source_size, target, copies and taken (copies * size; at most 3 * size). Draws come
    from hashes of ``by`` (else of ``keep``) and the seed, so a rerun on the same rows, however partitioned, agrees. A null or empty text
    has size 0 and is taken 0 times; a null source is a source of its own, the last; equal rows are rounded as one item
    and share its copies evenly; an empty table gives an empty result; a source of size 0 has target 0. Only ids and sizes are shuffled: a
    source is dealt out in blocks of about ``block_rows`` different rows, so a large one is spread over many tasks. Building the
    frame runs jobs.
    """
    keys = list(keep)
    rows = docs.withColumn("__text", F.xxhash64("text"))
    named = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in by or keys], "__text"))
    rows = sized(rows, [*dict.fromkeys([*keys, *(by or ())]), "__text"]).withColumn("__key", named)
    rows = cut(rows.withColumns({"__item": F.to_json(F.struct("__key", "source")), "__row": F.monotonically_increasing_id()}).drop("__text"))
    goal = cut(targets(rows, limit))
    # Equal rows are one item that is taken so many times more often: no block holds their number of rows.
    items = cut(rows.groupBy("__item", "__key", "source", "size").agg(F.count(F.lit(1)).alias("__same")))
    totals = items.groupBy("source").agg(F.count(F.lit(1)).alias("items")).agg(F.count(F.lit(1)).alias("sources"), F.max("items").alias("most")).first()
    blocks = max(1, math.ceil((totals["most"] or 0) / block_rows))
    items = items.withColumn("__order", F.xxhash64(F.lit(seed), F.col("__key"))).withColumn("__block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__key")), F.lit(blocks)).cast("int"))
    same = items["source"].eqNullSafe(goal["source"])
    if totals["sources"] <= BROADCAST_SOURCES:
        joined = items.join(F.broadcast(goal), same)
    else:
        salted = goal.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = items.join(salted, same & (F.pmod(items["__order"], F.lit(SALTS)) == salted["__salt"])).drop("__salt")
    joined = joined.select(*[items[c] for c in items.columns], "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("__same") * (F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    near = F.abs(rate - F.round(rate)) < 1e-9
    work = joined.withColumn("__whole", F.when(near, F.round(rate)).otherwise(F.floor(rate)).cast("long"))
    work = work.withColumn("__x", F.when(near, F.lit(0.0)).otherwise(rate - F.col("__whole")))
    done: list[DataFrame] = []
    while True:
        last = blocks == 1
        out = cut(_round(work, last, seed))
        if last:
            done.append(out)
            break
        open_row = (F.col("__x") > 0) & (F.col("__x") < 1)
        done.append(out.where(~open_row))
        blocks = math.ceil(blocks / fan_in)
        work = out.where(open_row).withColumn("__block", F.floor(F.col("__block") / fan_in).cast("int"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    every = cut(every.select("__item", "__same", "source_size", "target", F.when(F.col("size") > 0, F.col("__whole") + F.round("__x").cast("long")).otherwise(F.lit(0)).alias("__taken")))
    copies = _shared(rows, every)
    return copies.select(*keys, "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _shared(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows with their item's columns and copies: equal rows share what their item takes, the first of them one more where it does not divide.

    Equal rows are counted through by ranges of all repeated rows, so a row that stands there often is in many tasks.
    """
    repeated = items.where("__same > 1")
    starts = running(repeated, [F.col("__item").asc()], {"__past": F.col("__same").cast("double")}).select("__item", (F.col("__past") - F.col("__same")).alias("__start"))
    known = items.join(starts, "__item", "left")
    met = heavy_join(rows, known, ["__item"], "__same")
    single = met.where("__same = 1").withColumn("copies", F.col("__taken"))
    several = running(met.where("__same > 1"), [F.col("__item").asc(), F.col("__row").asc()], {"__number": F.lit(1.0)})
    each = F.floor(F.col("__taken") / F.col("__same"))
    more = (F.col("__number") - F.col("__start") <= F.col("__taken") % F.col("__same")).cast("long")
    shared = several.withColumn("copies", each + more)
    columns = [*rows.columns, "source_size", "target", "copies"]
    return single.select(*columns).unionByName(shared.select(*columns))


def mixed_rows(docs: DataFrame, seed: int = 7, limit: float = 3.0) -> DataFrame:
    """The rows, with all columns, as often as the mix takes them.

    Draws come from ids and texts, not from where rows lie. Null and empty texts are taken 0 times; a null source is a
    source of its own; equal rows share their copies evenly; an empty table stays empty; other columns, whatever their
    names, are carried along. Decisions go back to the rows as bitmaps; no text is shuffled. Building the frame runs jobs.
    """
    rows = filed(docs)
    taken = mix(located(rows, "doc_id", "source", "text"), ("doc_id", "__file", "__at"), seed, limit, by=("doc_id",))
    copies = cut(taken.select("__file", "__at", F.col("copies").alias("n")))
    kept = decided(rows, copies, math.ceil(limit)).where("__n > 0")
    return kept.select("__all", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__all.*")
