"""The class graph: lookups, hierarchy, inherited methods, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions import text as X
from ..session import written
from .keyword import light

OVERVIEW = "class_overview"


def overviews(chunks: DataFrame) -> DataFrame:
    return chunks.where((F.col("source") == "api") & (F.col("type") == OVERVIEW))


def one_per_name(chunks: DataFrame) -> DataFrame:
    """One overview of each simple name: of homonyms the one of least fqn, then id."""
    order = Window.partitionBy("class_name").orderBy("fqn", "chunk_id")
    return overviews(chunks).withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def ancestors(nodes: DataFrame, starts: DataFrame, depth: int = LIMITS.ancestors) -> DataFrame:
    """(query_id, depth, name) of the ancestors of each start (query_id, name), nearest first, at most ``depth`` of them.

    ``nodes`` has a row for each name with its ``parent``. The walk goes level by level: what a level reached is written,
    joined to the nodes once and left behind, so any number of starts may walk, and it ends with the level that reaches
    nothing. A name that a walk has met before ends it. Building the frame runs a job for each level.
    """
    edges = nodes.where(F.coalesce("parent", F.lit("")) != "").select("name", F.col("parent").alias("up"))
    level = starts.select("query_id", "name", F.array("name").alias("met"))
    found = None
    for k in range(depth):
        above = level.join(edges, "name").where(~F.array_contains("met", F.col("up")))
        level = written(above.select("query_id", F.col("up").alias("name"), F.concat("met", F.array("up")).alias("met")))
        part = level.select("query_id", F.lit(k).alias("depth"), "name")
        found = part if found is None else found.unionByName(part)
        if level.isEmpty():
            break
    return found if found is not None else level.select("query_id", F.lit(0).alias("depth"), "name").where(F.lit(False))


def inherited_methods(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """(query_id, depth, class_name, fqn, method_name, signature): public and protected methods of known ancestors of a class."""
    parents = one_per_name(chunks).select(F.col("class_name").alias("name"), F.coalesce("extends", F.lit("")).alias("__up"))
    up = starts.join(parents, "name").select("query_id", F.col("__up").alias("name")).where("name <> ''")
    return inherited_from(chunks, up)


def inherited_from(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """The same for a parent's name and its ancestors: the chain ends at the first name that has no overview."""
    classes = one_per_name(chunks)
    chain = ancestors(classes.select(F.col("class_name").alias("name"), F.coalesce("extends", F.lit("")).alias("parent")), parents, LIMITS.ancestors - 1)
    chain = parents.select("query_id", F.lit(0).alias("depth"), "name").unionByName(chain.withColumn("depth", F.col("depth") + 1))
    known = chain.join(classes.select(F.col("class_name").alias("name"), "fqn"), "name")
    methods = chunks.where((F.col("type") == "method") & F.col("visibility").isin("public", "protected"))
    signature = F.trim(X.shortened(X.second_line(F.col("body")), LIMITS.signature_chars))
    return known.join(methods.select("fqn", "method_name", signature.alias("signature")), "fqn").select("query_id", "depth", F.col("name").alias("class_name"), "fqn", "method_name", "signature")


def _segments(length: Column, k: int) -> list[tuple[Column, Column]]:
    """(start from 1, length) of the k + 1 even parts of a name of some length, the longer ones last."""
    each, longer = F.floor(length / (k + 1)).cast("int"), (length % (k + 1)).cast("int")
    short = lambda i: F.least(F.lit(i), F.lit(k + 1) - longer)
    return [((F.lit(i) * each + (F.lit(i) - short(i)) + 1).cast("int"), (each + (F.lit(i) >= F.lit(k + 1) - longer).cast("int")).cast("int")) for i in range(k + 1)]


def within_edits(names: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, class_name, distance): names at an edit distance of k or less of each asked (query_id, word), by equal keys.

    A name of length n is cut into k + 1 parts; of a name k edits away one part stays whole and moves by k places at most.
    So parts of the names meet the pieces of the asked words that a name of each possible length could have there; only
    names that meet are compared. No names are paired otherwise; parts are k + 1 rows a name. Words of 2 k letters or fewer,
    which names of no letter in common may reach, get no answer.
    """
    n = F.length("class_name").cast("int")
    own = names.select("class_name").where(n > k).distinct()
    parts = own.select("class_name", n.alias("n"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substr("class_name", at, size).alias("part")) for i, (at, size) in enumerate(_segments(n, k))])).alias("p")).select("class_name", "n", "p.*")
    words = asked.where(F.length("word") > 2 * k).select("query_id", "word", F.explode(F.sequence(F.length("word") - k, F.length("word") + k)).alias("n"))
    moves = F.sequence(F.lit(-k), F.lit(k))
    options = F.array(*[F.struct(F.lit(i).alias("i"), at.alias("at"), size.alias("size")) for i, (at, size) in enumerate(_segments(F.col("n"), k))])
    pieces = words.select("query_id", "word", "n", F.explode(options).alias("o"), moves.alias("moves")).select("query_id", "word", "n", "o.i", F.explode(F.transform("moves", lambda m: F.when((F.col("o.at") + m >= 1) & (F.col("o.at") + m + F.col("o.size") - 1 <= F.length("word")), F.substr("word", (F.col("o.at") + m).cast("int"), F.col("o.size"))))).alias("part"))
    met = parts.join(pieces.where(F.col("part").isNotNull()).distinct(), ["n", "i", "part"]).select("query_id", "word", "class_name").distinct()
    return met.withColumn("distance", F.levenshtein("word", "class_name")).where(F.col("distance") <= k).select("query_id", "class_name", "distance")


#: Edit distances that are tried one after the other, and asked words that then go to all names at a time.
EDITS, WORDS_A_PASS = (2, 4), 1_000


def suggestions(chunks: DataFrame, asked: DataFrame, shown: int = 5) -> DataFrame:
    """(query_id, chunk_id, body, distance): the overviews of least edit distance to each asked (query_id, name), no further than its length.

    Names within two edits come by equal keys, then within four for the words that have too few; what is found within k
    edits comes before all else, so the first ``shown`` of it are final. Words that still have too few are a stated set
    that goes to every overview in blocks. Ties by class name, then id. Building the frame runs jobs for each of the steps.
    """
    every = overviews(chunks).where(F.length("class_name") > 0).select("class_name", "chunk_id", "body")
    left = written(asked.select("query_id", X.last_segment(F.col("name")).alias("word"), F.length("name").alias("most")))
    found, order = None, Window.partitionBy("query_id").orderBy("distance", "class_name", "chunk_id")
    first = lambda rows: rows.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= shown).drop("__rn")
    for k in EDITS:
        near = within_edits(every, left, k).join(left, "query_id").where(F.col("distance") <= F.col("most")).select("query_id", "class_name", "distance")
        got = written(first(every.select("class_name", "chunk_id").join(light(near), "class_name")).select("query_id", "chunk_id", "distance"))
        sure = got.groupBy("query_id").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= shown).select("query_id")
        part = got.join(sure, "query_id", "left_semi")
        found = part if found is None else found.unionByName(part)
        left = written(left.join(sure, "query_id", "left_anti"))
        if left.isEmpty():
            break
    words = left.count()
    for block in range(-(-words // WORDS_A_PASS)):
        mine = left.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-words // WORDS_A_PASS))) == block)
        rows = mine.toArrow().to_pylist()
        if not rows:
            continue
        kind = left.schema["query_id"].dataType
        listed = F.array(*[F.struct(F.lit(r["query_id"]).cast(kind).alias("query_id"), F.lit(r["word"]).alias("word"), F.lit(r["most"]).alias("most")) for r in rows])
        met = every.select("class_name", "chunk_id", F.explode(F.transform(listed, lambda w: F.struct(w["query_id"].alias("query_id"), w["most"].alias("most"), F.levenshtein(w["word"], F.col("class_name")).alias("distance")))).alias("w"))
        part = first(met.select("w.*", "class_name", "chunk_id").where(F.col("distance") <= F.col("most"))).select("query_id", "chunk_id", "distance")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return every.limit(0).join(asked.select("query_id").limit(0)).select("query_id", "chunk_id", "body", F.lit(0).alias("distance"))
    return every.select("chunk_id", "body").join(light(found), "chunk_id").select("query_id", "chunk_id", "body", "distance")


def class_info(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, tier, chunk_id, body, distance): what a name (query_id, name) stands for.

    A name with a dot: all chunks of that fqn; else overviews of the simple name; else any chunk of that class name; else
    the five overviews of least edit distance, as suggestions (tier 3). What is sure is found first and written; only
    names without are looked for by their spelling.
    """
    api = chunks.where(F.col("source") == "api").select("type", "fqn", "class_name", "chunk_id", "body")
    dotted = F.col("name").contains(".")
    key = lambda d, tier: d.select("query_id", F.lit(tier).alias("tier"), "chunk_id", "body", F.lit(0).alias("distance"))
    # A name with dots meets full names, any name class names: two equal-key joins over one reading each.
    full = names.where(dotted).join(api, F.col("name") == F.col("fqn"))
    simple = names.join(api, X.last_segment(F.col("name")) == F.col("class_name"))
    tier = F.when(~dotted & (F.col("type") == OVERVIEW), 0).otherwise(1)
    sure = key(full, 0).unionByName(simple.select("query_id", tier.alias("tier"), "chunk_id", "body", F.lit(0).alias("distance")))
    sure = sure.withColumn("__best", F.min("tier").over(Window.partitionBy("query_id")))
    sure = written(sure.where(F.col("tier") == F.col("__best")).drop("__best"))
    missing = names.join(sure.select("query_id").distinct(), "query_id", "left_anti")
    if missing.isEmpty():
        return sure
    near = suggestions(chunks, missing)
    return sure.unionByName(near.select("query_id", F.lit(3).alias("tier"), "chunk_id", "body", "distance"))


def first_members(members: DataFrame, group: str, member: str, shown: int, once: bool = True) -> DataFrame:
    """(group, total, shown): how many members each group has, distinct ones unless not ``once``, and the first of them, sorted.

    Ranks are pruned before their shuffle, so no list is longer than what is shown.
    """
    rows = members.select(group, member).where(F.col(member).isNotNull())
    rows = rows.distinct() if once else rows
    total = rows.groupBy(group).agg(F.count(F.lit(1)).cast("int").alias("total"))
    first = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(member))).where(F.col("__rn") <= shown)
    return total.join(first.groupBy(group).agg(F.sort_array(F.collect_list(member)).alias("shown")), group)


def subclasses(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, total, shown): full names of the classes that extend a name, distinct and sorted, the first thirty shown."""
    found = names.join(overviews(chunks).select("extends", F.coalesce(F.nullif(F.col("fqn"), F.lit("")), F.lit("?")).alias("fqn")), F.col("name") == F.col("extends"))
    return first_members(found, "query_id", "fqn", LIMITS.relations_shown)


def implementors(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, total, shown): full names of all classes whose list of interfaces has a name, sorted, the first thirty shown."""
    some = overviews(chunks).where(F.coalesce("implements", F.lit("")) != "")
    edges = some.select(F.coalesce(F.nullif(F.col("fqn"), F.lit("")), F.lit("?")).alias("fqn"), F.explode(F.array_distinct(X.csv(F.col("implements")))).alias("interface"))
    return first_members(names.join(edges, F.col("name") == F.col("interface")), "query_id", "fqn", LIMITS.relations_shown, False)


def hierarchy(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each known name: what it extends and implements, its parent's own, its subclasses and implementors."""
    classes = one_per_name(chunks).select("class_name", "fqn", "extends", "implements")
    own = names.join(classes, F.col("name") == F.col("class_name"))
    parent = classes.select(F.col("class_name").alias("extends"), F.col("extends").alias("parent_extends"), F.col("implements").alias("parent_implements"))
    joined = own.join(parent, "extends", "left")
    subs = subclasses(chunks, names).select("query_id", F.col("total").alias("n_subclasses"), F.col("shown").alias("subclasses"))
    imps = implementors(chunks, names).select("query_id", F.col("total").alias("n_implementors"), F.col("shown").alias("implementors"))
    return joined.join(subs, "query_id", "left").join(imps, "query_id", "left").select("query_id", "fqn", "extends", "implements", "parent_extends", "parent_implements", "n_subclasses", "subclasses", "n_implementors", "implementors")


def packages(members: DataFrame, shown: int = LIMITS.packages_shown) -> DataFrame:
    """(package, classes, shown, more) of (package, class_name) rows, one for each class: sorted names, the first twenty, and how many are left out.

    Every class counts, so a name that two classes of a package share is there twice; a class without a name is '?'.
    """
    named = members.select(F.coalesce(F.nullif(F.col("package"), F.lit("")), F.lit("(default)")).alias("package"), F.coalesce(F.nullif(F.col("class_name"), F.lit("")), F.lit("?")).alias("class_name"))
    return first_members(named, "package", "class_name", shown, False).select("package", F.col("total").alias("classes"), "shown", F.greatest(F.col("total") - shown, F.lit(0)).alias("more"))


def package_totals(found: DataFrame) -> DataFrame:
    """One row: the packages and the classes of a package list."""
    return found.agg(F.count(F.lit(1)).alias("packages"), F.coalesce(F.sum("classes"), F.lit(0)).cast("long").alias("classes"))


def class_report(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, text): all that a name stands for, with the inherited methods of its first overview; or suggestions.

    Parts of one name are a few chunks and the methods of at most six ancestors, sorted before they are joined.
    """
    info = class_info(chunks, names).join(chunks.select("chunk_id", "fqn", "type", "extends"), "chunk_id")
    part = F.when(F.col("tier") < 3, F.concat(F.lit("### "), F.coalesce("fqn", F.lit("")), F.lit(" ("), F.coalesce("type", F.lit("")), F.lit(")\n"), F.coalesce("body", F.lit(""))))
    own = info.groupBy("query_id").agg(
        F.min("tier").alias("tier"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fqn", "chunk_id", part.alias("part")))), lambda x: x["part"]), "\n\n---\n\n").alias("parts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("distance", "fqn"))), lambda x: F.concat(F.lit("  - "), x["fqn"])), "\n").alias("near"),
        F.min(F.when(F.col("type") == OVERVIEW, F.struct("fqn", "chunk_id", "extends"))).alias("first"),
    )
    lines = inherited_from(chunks, own.where("tier < 3").select("query_id", F.col("first.extends").alias("name")).where("name <> ''"))
    block = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("depth", "method_name", F.concat(F.lit("  "), F.col("signature"), F.lit(";  // inherited from "), F.col("fqn")).alias("line")))).alias("l"))
    inherited = F.when(F.col("l").isNotNull(), F.concat(F.lit("\n\n---\n\n### Inherited Methods\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))).otherwise("")
    every = names.join(own, "query_id", "left").join(block, "query_id", "left")
    missing = F.concat(F.lit("Class '"), F.col("name"), F.lit("' not found"))
    text = F.when(F.col("tier") < 3, F.concat("parts", inherited)).when(F.col("tier") == 3, F.concat(missing, F.lit(" exactly. Did you mean:\n"), F.col("near"))).otherwise(F.concat(missing, F.lit(" in the index.")))
    return every.select("query_id", text.alias("text"))
