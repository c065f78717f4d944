"""Golden and property tests of the operators on hand-made corpora."""

from __future__ import annotations

import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.config import CHUNKS, LIMITS, SNAPSHOT
from corvane.functions import text as X
from corvane.functions.porter import folded, porter
from corvane.operators import boosts, code, diff, fusion, graph, keyword, shaping
from corvane.plans.search import Search, as_json, rendered
from corvane.sources import store


def chunk(**values):
    return tuple(values.get(f.name) for f in CHUNKS.fields)


def overview(name, package="a.b", extends=None, implements=None, body="", **more):
    fqn = f"{package}.{name}" if package else name
    return chunk(chunk_id=more.pop("chunk_id", fqn), source="api", type="class_overview", fqn=fqn, class_name=name, package=package, extends=extends, implements=implements, body=body, **more)


def method(owner, name, visibility="public", package="a.b", line="void x();"):
    fqn = f"{package}.{owner}"
    return chunk(chunk_id=f"{fqn}#{name}", source="api", type="method", fqn=fqn, class_name=owner, method_name=name, visibility=visibility, package=package, body=f"// {owner}\n  {line}\nmore")


@pytest.fixture(scope="module")
def classes(spark):
    chain = [overview(f"Node{i}", extends=f"Node{i + 1}") for i in range(8)] + [overview("Node8")]
    loop = [overview("Ping", extends="Pong"), overview("Pong", extends="Ping")]
    more = [overview("Twin", package="a.b"), overview("Twin", package="c.d"), overview("Shape", package=""), overview("Square", implements="Shape, Drawable"), overview("Circle", implements="Drawable,Shape"), overview("Blob", implements="Shape")]
    methods = [method(f"Node{i}", f"step{i}", "public" if i % 2 else "private") for i in range(9)] + [method("Node1", f"m{i}") for i in range(22)]
    return spark.createDataFrame(chain + loop + more + methods, CHUNKS)


def names(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "query_id int, name string")


def test_ancestors_stop_at_depth_and_cycles(spark, classes):
    nodes = graph.one_per_name(classes).select(F.col("class_name").alias("name"), F.coalesce("extends", F.lit("")).alias("parent"))
    got = sorted((r.query_id, r.depth, r.name) for r in graph.ancestors(nodes, names(spark, "Node0", "Ping", "Node8", "None")).collect())
    assert [x for x in got if x[0] == 0] == [(0, d, f"Node{d + 1}") for d in range(LIMITS.ancestors)]
    assert [x for x in got if x[0] == 1] == [(1, 0, "Pong")]
    assert not [x for x in got if x[0] > 1]


def test_inherited_methods(spark, classes):
    got = {(r.depth, r.class_name, r.method_name) for r in graph.inherited_methods(classes, names(spark, "Node0")).collect()}
    assert {(0, "Node1", "step1"), (2, "Node3", "step3")} <= got
    assert not any(m == "step2" for _, _, m in got)


def test_class_info_tiers(spark, classes):
    got = {}
    for r in graph.class_info(classes, names(spark, "a.b.Node1", "Twin", "Squar")).collect():
        got.setdefault(r.query_id, []).append((r.tier, r.chunk_id))
    assert len(got[0]) == 24 and sorted(got[1]) == [(0, "a.b.Twin"), (0, "c.d.Twin")]
    assert min(got[2])[0] == 3 and (3, "a.b.Square") in got[2] and len(got[2]) == 5


def test_hierarchy(spark, classes):
    got = {r.query_id: r for r in graph.hierarchy(classes, names(spark, "Node1", "Shape")).collect()}
    assert got[0].extends == "Node2" and got[0].parent_extends == "Node3" and got[0].subclasses == ["a.b.Node0"]
    assert got[1].implementors == ["a.b.Blob", "a.b.Circle", "a.b.Square"]


def test_packages_default_and_cap(spark):
    rows = [("", "A"), (None, "B"), *[("p", f"C{i:02}") for i in range(25)]]
    got = {r.package: r for r in graph.packages(spark.createDataFrame(rows, "package string, class_name string")).collect()}
    assert got["(default)"].shown == ["A", "B"] and got["p"].more == 5 and len(got["p"].shown) == 20


def test_humps(spark):
    words = ["Vector3d", "ECS2", "HTTPServer", "x.Y.Zed"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.regexp_extract_all("w", F.lit(X.QUERY_HUMPS), F.lit(0)).alias("h")).collect()
    assert [r.h for r in got] == [["Vector", "d"], ["EC"], ["HTTP", "Server"], ["x", "Zed"]]
    got = spark.createDataFrame([(w,) for w in ("ECS2", "UIEventBuilder", "MyECSFoo2")], "w string").select(F.regexp_extract_all("w", F.lit(X.CLASS_HUMPS), F.lit(0)).alias("h")).collect()
    assert [r.h for r in got] == [["ECS"], ["UI", "Event", "Builder"], ["My", "ECS", "Foo"]]


def test_class_name_overlap(spark):
    named = ["BreakBlockEvent", "EnvironmentBreakBlockEvent", "PlayerDisconnectEvent", "PlayerSetupDisconnectEvent", "CustomPage", "Unrelated"]
    table = boosts.description_names(spark.createDataFrame([(i, f"x.y.{n}") for i, n in enumerate(named)], "ord int, fqn string"))
    asked = spark.createDataFrame([(1, "how do I cancel a block break"), (2, "player disconnects from the server"), (3, "register a custom command")], "query_id int, query string")
    from corvane.config import CLASS_NOISE

    asked = asked.select("query_id", X.query_stems(F.col("query"), CLASS_NOISE).alias("stems"))
    got = [(r.query_id, r.name, round(r.score, 3)) for r in boosts.overlapping_names(asked, table).orderBy("query_id", "no").collect()]
    assert got == [(1, "BreakBlockEvent", 1.0), (1, "EnvironmentBreakBlockEvent", 0.667), (2, "PlayerDisconnectEvent", 1.0), (2, "PlayerSetupDisconnectEvent", 0.667), (3, "CustomPage", 0.5)]


def test_fusion_scores_and_gate(spark):
    dense = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "query_id int, chunk_id string, pos int").withColumn("source", F.lit("api"))
    words = spark.createDataFrame([(1, "c", 0), (1, "b", 1), (1, "a", 2), (2, "z", 0)], "query_id int, chunk_id string, pos int").withColumn("source", F.lit("api"))
    got = [(r.chunk_id, r.rrf_score) for r in fusion.fuse(dense, words, 3).where("query_id = 1").orderBy("pos").collect()]
    assert [c for c, _ in got] == ["a", "b", "c"] and abs(got[0][1] - (1 / 60 + 0.3 / 62)) < 1e-9
    asked = spark.createDataFrame([(1, "plain words"), (2, "also plain")], "query_id int, query string")
    assert {r.query_id for r in fusion.gate(words, dense, asked).collect()} == {2}
    assert {r.query_id for r in fusion.gate(words, dense, asked.withColumn("query", F.lit("Named"))).collect()} == {1, 2}


def test_known_ids_go_after_the_cut(spark):
    dense = spark.createDataFrame([(1, "a", 0), (1, "gone", 1), (1, "b", 2)], "query_id int, chunk_id string, pos int").withColumn("source", F.lit("api"))
    known = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert [r.chunk_id for r in fusion.fuse(dense, dense.limit(0), 2, known).collect()] == ["a"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["api", "guide", "mod", "x"]), st.sampled_from(["", "p", "q"])), max_size=12), st.integers(1, 8))
def test_slots_and_caps(spark, rows, limit):
    hits = spark.createDataFrame([(1, f"c{i}", s, k, i) for i, (s, k) in enumerate(rows)], "query_id int, chunk_id string, source string, fqn string, pos int")
    kept = shaping.first_per_key(hits).collect()
    for key in "pq":
        assert sum(r.fqn == key for r in kept) == min(2, sum(k == key for _, k in rows))
    assert sum(r.fqn == "" for r in kept) == sum(k == "" for _, k in rows)
    got = shaping.with_slots(hits, limit).orderBy("pos").collect()
    assert len(got) == min(limit, len(rows)) and [r.pos for r in got] == list(range(len(got)))
    want, used = [], []
    for source, n in LIMITS.slots:
        part = [i for i, (s, _) in enumerate(rows) if s == source][:n]
        used += part
    want = (used + [i for i in range(len(rows)) if i not in used])[:limit]
    assert [r.chunk_id for r in got] == [f"c{i}" for i in want]


def test_bm25_against_full_text_search(spark):
    """Scores with the stemming analyser equal those of SQLite's full-text search over the same rows."""
    bodies = ["The running runner runs a.b quickly", "a b runs", "Nothing here at all", "quick caféS and a runner", "the block type BlockType", "a.b a.b and relational databases"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(body, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", list(enumerate(bodies, 1)))
    chunks = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies, 1)], "chunk_id string, body string")
    phrases = ["runner", "a.b", "cafes", "relational", "quick"]
    for p in phrases:
        want = {str(r): -s for r, s in con.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (f'"{p}"',))}
        asked = spark.createDataFrame([(1, 0, p)], "query_id int, phrase_no int, phrase string")
        got = {r.chunk_id: r.score for r in keyword.bm25(keyword.Index.of(chunks, analyzer="porter"), asked).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want), p


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("conditional", "condit"), ("probate", "probat"), ("controlling", "control"), ("happy", "happi"), ("sky", "sky"), ("agreed", "agre"), ("on", "on")])
def test_porter(word, want):
    assert porter(word) == want
    assert folded("Éçole") == "ecole"


SOURCE = """package a.b;

/** A door. */
public class Door {
    /** Width of {@code open}. */
    private int width = 3;
    static final int[] SIZES = { 1, 2 };

    /** Makes one. */
    public Door(int width) {
        this.width = width;
    }

    /** Opens it. */
    @Override
    @Marks({"a;", "}"})
    public boolean open(String key, int times) throws LockedException {
        if (times > 0) { return check("} \\" {" + key); } // }
        char c = '{'; /* } */
        return false;
    }

    // a remark
    protected <T extends Key> boolean open(final T key) {
        new Thread(new Runnable() { public void run() { open(key.name(), 1); } });
        for (int i = 0; i < 3; i++) { check(i); }
        return open(key.name(), 1);
    }

    abstract void close();

    public record Point(int x, int y) { }

    private void torn() {
        if (width > 0) {
"""


def test_method_sources(spark):
    files = spark.createDataFrame([("D", SOURCE), ("E", ""), ("F", None)], "file string, text string")
    found = {(r.file, r.name, r.constructor) for r in code.members(files).collect()}
    assert found == {("D", "Door", True), ("D", "open", False), ("D", "run", False), ("D", "close", False), ("D", "torn", False)}
    wanted = spark.createDataFrame([(i, f, "a.b.Door", m) for i, (f, m) in enumerate([("D", "open"), ("D", "close"), ("D", "<init>"), ("D", "absent"), ("D", "run"), ("E", "open"), ("G", "open"), ("D", "torn")])], "query_id int, file string, class_name string, method_name string")
    got = {r.query_id: r.method_source for r in code.method_sources(files, wanted).collect()}
    one, two = got[0].split(code.BETWEEN)
    assert one.startswith("/** Opens it. */") and one.endswith("return false;\n    }") and two.startswith("protected <T") and two.endswith("return open(key.name(), 1);\n    }")
    assert got[1] == "abstract void close()" and got[2] == "/** Makes one. */\n    public Door(int width) {\n        this.width = width;\n    }"
    assert got[3] == got[5] == "" and 6 not in got and got[4] == "public void run() { open(key.name(), 1); }" and got[7] == "private void torn()"


def test_method_report(spark):
    chunks = spark.createDataFrame([overview("Door", file="D"), overview("Wall"), overview("Gone", file="X"), method("Only", "x"), overview("Door", package="z", file="Z")], CHUNKS)
    files = spark.createDataFrame([("D", SOURCE)], "file string, text string")
    asked = [("Door", "close"), ("a.b.Door", "none"), ("Nobody", "x"), ("Wall", "x"), ("Gone", "x"), ("Only", "x"), ("q.Door", "x")]
    wanted = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "query_id int, class_name string, method_name string")
    got = {r.query_id: r.text for r in code.method_report(chunks, files, wanted).collect()}
    assert got == {0: "// a.b.Door.close — full source\n\nabstract void close()", 1: "Method 'none' not found in a.b.Door.", 2: "Class 'Nobody' not found.", 3: "No file path found for this class.", 4: "Source file not found: X", 5: "No file path found for this class.", 6: "Class 'q.Door' not found."}


def test_labelled_usages(spark):
    files = spark.createDataFrame([(f"f{i}", "no\nturn on\non") for i in range(4)], "file string, text string")
    chunks = spark.createDataFrame([("m1", "A.java", "repo", "x on " * 90), ("m2", None, "", None)], "chunk_id string, file string, repo string, body string")
    hits = spark.createDataFrame([("m2", 1), ("m1", 0), ("lost", 2)], "chunk_id string, pos int")
    rows = code.labelled_usages(files, "on", code.example_usages(hits, chunks), 9).orderBy("no").collect()
    assert [(r.source, r.file, r.line) for r in rows] == [("api", f"f{i}", k) for i in range(4) for k in (2, 3)] + [("mod:repo", "A.java", 0)] and len(rows[-1].text) == 200
    text = code.usage_report(code.labelled_usages(files, "on", code.example_usages(hits, chunks), 12), "on").first().text
    assert text.startswith("# Usages of 'on' (10 results)\n\n[api] f0:2\n  turn on") and text.endswith("[mod:?] \n  ")
    assert code.usage_report(code.labelled_usages(files, "off", code.example_usages(hits.limit(0), chunks)), "off").first().text == "No usages of 'off' found."


def test_gram_index(spark, tmp_path):
    """Candidates hold every file that has the name; others are not read; short names and odd texts are right."""
    import random

    from corvane.operators import grams

    rng = random.Random(2)
    texts = [(f"f{i:04}", " ".join(rng.choice(["one", "door", "dooor", "é😀x", "a.b"]) for _ in range(30)) + ("\nneedle\n" if i % 50 == 0 else "\nneed led\n")) for i in range(400)] + [("long", "x" * 9000 + " needle " + "y" * 9000), ("null", None), ("tiny", "ne")]
    files = spark.createDataFrame(texts, "file string, text string")
    piece = grams.PIECE
    grams.PIECE = 100
    try:
        index = grams.GramIndex.write(files.repartition(3), str(tmp_path))
    finally:
        grams.PIECE = piece
    key = lambda d: sorted((r.file, r.line, r.text) for r in d.collect())
    for name in ("needle", "é😀x", "a.b", "on", "absent", "door"):
        assert key(index.usages(name)) == key(code.usages(files, name))
    assert {r.file for r in index.candidates("needle").collect()} == {f"f{i:04}" for i in range(0, 400, 50)} | {"long"} and index.candidates("on") is None
    assert "In(file" in index.texts("needle")._jdf.queryExecution().executedPlan().toString() or "file IN" in index.texts("needle")._jdf.queryExecution().executedPlan().toString()
    few = grams.FEW_FILES
    try:
        grams.FEW_FILES = 2
        assert key(index.usages("needle")) == key(code.usages(files, "needle"))
    finally:
        grams.FEW_FILES = few
    assert {(r.gram, r.file) for r in grams.file_grams(files).where("file = 'tiny' OR file = 'null'").collect()} == set()


def test_log_sink(spark, tmp_path):
    """Several batches, a restart and a batch that runs again leave the last rows, and every row once."""
    from corvane.streaming import logs

    schema = "time timestamp, log_id long, module string, message string"
    row = lambda i: (f"2024-01-01 00:{i // 60:02}:{i % 60:02}", i, f"m{i % 3}", f"text {i}")
    write = lambda part: spark.createDataFrame([row(i) for i in part], "time string, log_id long, module string, message string").withColumn("time", F.to_timestamp("time")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root, state = str(tmp_path / "out"), str(tmp_path / "state")
    assert logs.tail(spark, root, schema).count() == 0
    write(range(40))
    write(range(40, 45))
    logs.sink(stream(), root, state, kept=10).awaitTermination(120)
    assert [r.log_id for r in logs.tail(spark, root, schema).collect()] == list(range(44, 34, -1))
    write(range(45, 48))
    write([3, 4])  # late rows
    logs.sink(stream(), root, state, kept=10).awaitTermination(120)
    assert [r.log_id for r in logs.tail(spark, root, schema).collect()] == list(range(47, 37, -1))
    assert spark.read.schema(schema).parquet(root + "/all/*").count() == 50 and len(logs._batches(spark, root + "/last")) == 2
    for left in ("3", ".3.crc"):  # the last batch was not committed: it runs again
        (tmp_path / "state" / "commits" / left).unlink()
    logs.sink(stream(), root, state, kept=10).awaitTermination(120)
    assert [r.log_id for r in logs.tail(spark, root, schema).collect()] == list(range(47, 37, -1)) and spark.read.schema(schema).parquet(root + "/all/*").count() == 50
    logs.sink(stream(), root + "2", state + "2", kept=2, by=("module",)).awaitTermination(120)
    assert [r.log_id for r in logs.tail(spark, root + "2", schema).collect()] == list(range(47, 41, -1))


def test_unchanged_groups_are_not_joined(spark):
    make = lambda changed: spark.createDataFrame([(f"p{i % 9}.C{i}", f"C{i}", None if i % 9 == 8 else f"p{i % 9}", "", "", [f"m{i}"] + (["new"] if i in changed else []), []) for i in range(90) if i != 80 or not changed], SNAPSHOT)
    old, new = make(()), make((3, 12, 44))
    parts = diff.changed_rows(old, new)
    assert parts[0].count() == 20 and parts[1].count() == 19
    key = lambda d: sorted((r.fqn, r.kind, r.changes) for r in d.collect())
    assert key(diff.differences(*parts)) == key(diff.differences(old, new)) and len(key(diff.differences(*parts))) == 4
    few = diff.FEW_GROUPS
    try:
        diff.FEW_GROUPS = 0
        assert key(diff.differences(*diff.changed_rows(old, new, known=(diff.digests(old), diff.digests(new))))) == key(diff.differences(old, new))
    finally:
        diff.FEW_GROUPS = few
    assert diff.changed_groups(diff.digests(old), diff.digests(old.orderBy("class_name"))).count() == 0 and diff.changed_rows(old.limit(0), old)[1].count() == 90


def test_walks_have_no_row_limit(spark):
    """More walks than a recursive query would allow rows."""
    nodes = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n9", None), ("x", "x")], "name string, parent string")
    starts = spark.range(400_000).select(F.col("id").alias("query_id"), F.concat(F.lit("n"), (F.col("id") % 5).cast("string")).alias("name"))
    got = graph.ancestors(nodes, starts, 4)
    assert got.count() == 1_600_000 and got.where("query_id = 7").orderBy("depth").select("name").collect() == [("n3",), ("n4",), ("n5",), ("n6",)]
    assert graph.ancestors(nodes, starts.limit(0)).count() == 0 and graph.ancestors(nodes, names(spark, "x", "n9")).count() == 0


def test_names_within_edits(spark):
    """Equal keys give all names within k edits, as comparing all pairs does."""
    import random

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abAB") for _ in range(rng.randrange(1, 13))) for _ in range(300)})
    held = spark.createDataFrame([(w,) for w in words], "class_name string")
    asked = spark.createDataFrame(list(enumerate(["".join(rng.choice("abAB") for _ in range(rng.randrange(1, 13))) for _ in range(40)] + [""])), "query_id int, word string")
    for k in (1, 2, 4):
        got = {(r.query_id, r.class_name, r.distance) for r in graph.within_edits(held, asked, k).collect()}
        pairs = asked.where(F.length("word") > 2 * k).crossJoin(held).withColumn("d", F.levenshtein("word", "class_name")).where(F.col("d") <= k)
        assert got == {(r.query_id, r.class_name, r.d) for r in pairs.collect()}


def test_suggestions_are_the_nearest(spark):
    import random

    rng = random.Random(5)
    rows = [overview("".join(rng.choice("abcA") for _ in range(rng.randrange(1, 12))), chunk_id=f"c{i}") for i in range(200)] + [overview("", chunk_id="e"), overview(None, chunk_id="n")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = names(spark, "abcabcabc", "abA", "q.abcAbcA", "zzzzzzzzzzzz", "x", "")
    passes, graph.WORDS_A_PASS = graph.WORDS_A_PASS, 2
    try:
        got = {(r.query_id, r.chunk_id, r.distance) for r in graph.suggestions(chunks, asked).collect()}
    finally:
        graph.WORDS_A_PASS = passes
    pairs = asked.crossJoin(chunks.where(F.length("class_name") > 0)).withColumn("d", F.levenshtein(X.last_segment(F.col("name")), F.col("class_name"))).where(F.col("d") <= F.length("name")).collect()
    want = set()
    for q in range(6):
        mine = sorted((r.d, r.class_name, r.chunk_id) for r in pairs if r.query_id == q)[:5]
        want |= {(q, c, d) for d, _, c in mine}
    assert got == want


def test_usages(spark):
    files = spark.createDataFrame([("A", "package x.on;\nturn on\nonly\n on.off()"), ("B", "none")], "file string, text string")
    assert [(r.file, r.line, r.text) for r in code.first_usages(files, "on").collect()] == [("A", 2, "turn on"), ("A", 4, "on.off()")]


def test_snapshot_and_diff(spark, tmp_path):
    body = "class A\n// Fields:\n int b;\nint a;\n// Methods:\nx"
    rows = [overview("A", body=body), overview("A", body=body, chunk_id="zz", extends="B"), method("A", "run"), method("A", "run"), method("A", "go"), overview("C")]
    new = diff.snapshot(spark.createDataFrame(rows, CHUNKS))
    a = {r.class_name: r for r in new.collect()}["A"]
    assert a.methods == ["go", "run"] and a.fields == ["int a", "int b"] and a.extends == "B"
    old = spark.createDataFrame([("a.b.A", "A", "a.b", "", "", [f"m{i}" for i in range(7)], ["int a"]), ("gone.G", "G", "gone", "", "", [], [])], SNAPSHOT)
    got = {r.fqn: r for r in diff.differences(old, new).collect()}
    assert (got["a.b.C"].kind, got["gone.G"].kind, got["a.b.A"].kind) == ("added", "removed", "modified")
    assert got["a.b.A"].changes == ["extends:  -> B", "methods added: go, run", "methods removed: m0, m1, m2, m3, m4, ... and 2 more", "fields added: int b"]
    assert diff.differences(new, new).count() == 0
    assert "modified (1): a.b.A" in diff.summary(diff.differences(old, new)).first().summary
    assert diff.summary(diff.differences(new, new)).first().summary == "No changes."
    versions = store.Versions(spark, str(tmp_path))
    assert versions.snapshots() == (None, None) and versions.last_diff() is None
    versions.rotate(old)
    versions.rotate(new)
    versions.rotate(new)
    was, now = versions.snapshots()
    assert diff.differences(was, now).count() == 0
    versions.save_diff(diff.differences(old, new), "text")
    assert versions.last_diff()["summary"] == "text"


def test_backups(spark, tmp_path, classes):
    versions = store.Versions(spark, str(tmp_path))
    assert versions.list().count() == 0
    one, two = versions.backup(classes, "my label/x"), versions.backup(classes.limit(3))
    assert "my_label_x" in one and [r.file for r in versions.list().collect()][0] == two
    assert versions.restore(two).count() == 3
    assert versions.delete(one) and not versions.delete("absent") and [r.file for r in versions.list().collect()] == [two]
    with pytest.raises(ValueError):
        versions.restore("absent")


def test_restore_switches_what_is_read(spark, tmp_path, classes):
    root = str(tmp_path)
    versions = store.Versions(spark, root)
    one = versions.backup(classes, "one", {"jar": "a"}, current=True)
    two = versions.backup(classes.limit(3), "two", {"jar": "b"}, current=True)
    assert store.collection(spark, root).count() == 3 and versions.meta() == {"jar": "b"}
    versions.restore(one)
    assert store.collection(spark, root, "api").count() == classes.count() and versions.meta() == {"jar": "a"}
    assert not versions.delete(one) and versions.delete(two) and [r.file for r in versions.list().collect()] == [one]
    with pytest.raises(ValueError):
        versions.restore(two)
    assert versions.current().count() == classes.count() and "PartitionFilters: [isnotnull(source" in store.collection(spark, root, "api")._jdf.queryExecution().toString()


def test_writers_do_not_lose_records(spark, tmp_path):
    """Writers at the same time all end up in the ledger; a commit that was overtaken starts again."""
    from concurrent.futures import ThreadPoolExecutor

    from corvane.sources.ledger import Ledger

    ledger, tries = Ledger(spark, str(tmp_path)), []

    def add(i):
        Ledger(spark, str(tmp_path)).commit(lambda state: (tries.append(i), state | {"meta": state["meta"] | {str(i): i}})[1])

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(add, range(24)))
    number, state = ledger.read()
    assert number == 24 and state["meta"] == {str(i): i for i in range(24)} and len(tries) >= 24 and len(ledger._numbers()) == 20

    def late(state):
        if len(tries) < 1000:
            tries.extend(range(1000))
            ledger.commit(lambda other: other | {"current": "other"})
        return state | {"meta": {}}

    assert ledger.commit(late)["current"] == "other"
    versions = store.Versions(spark, str(tmp_path))
    versions.update_meta("k", 1)
    assert versions.meta() == {"k": 1}


def test_collections(spark, tmp_path, classes):
    path = str(tmp_path / "chunks")
    store.write_chunks(classes, path)
    api = store.collection(spark, path, "api")
    assert api.count() == classes.count() and store.collection(spark, path, "guides").count() == 0
    assert store.get(api, where={"class_name": "Twin"}, limit=1).first().chunk_id == "a.b.Twin"
    assert store.get(api, ids=["a.b.Blob"]).count() == 1 and store.get(api, prefix={"package": "c"}).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "one" / "sub").mkdir(parents=True)
    (tmp_path / "one" / "SKILL.md").write_text("x")
    (tmp_path / "one" / "sub" / "a.md").write_text("y")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.md").write_text("z")
    (tmp_path / "two" / "B.java").write_text("class B {}")
    got = {r.name: (r.files, r.has_skill) for r in store.skills(spark, str(tmp_path)).collect()}
    assert got == {"one": (["SKILL.md", "sub/a.md"], True), "two": (["b.md"], False)}
    assert [r.text for r in store.source_files(spark, str(tmp_path)).collect()] == ["class B {}"]


@settings(max_examples=10, deadline=None)
@given(st.text(alphabet="abc é\n", max_size=60))
def test_windows_rebuild_the_text(spark, text):
    got = store.chunk_windows(spark.createDataFrame([(1, text)], "id int, text string"), 10, 3).orderBy("chunk_no").collect()
    rebuilt = "".join(r.body if i == 0 else r.body[3:] for i, r in enumerate(got))
    assert rebuilt == text


def test_search_engine(spark, classes):
    guides = spark.createDataFrame([chunk(chunk_id="g1", source="guide", type="guide", title="Shapes", heading="About `Square`", body="drawing a square"), chunk(chunk_id="m1", source="mod", type="mod", repo="r", file="F.java", body="square root")], CHUNKS)
    texts = classes.withColumn("body", F.concat_ws(" ", "class_name", "method_name"))
    engine = Search(texts.unionByName(guides), descriptions=spark.createDataFrame([(0, "a.b.Square")], "ord int, fqn string"))
    asked = spark.createDataFrame([(1, "square"), (2, "Circle please")], "query_id int, query string")
    hits = engine.docs(asked)
    got = {(r.query_id, r.pos): r.chunk_id for r in hits.collect()}
    assert got[1, 0] == "a.b.Square" and got[2, 0] == "a.b.Circle" and "g1" in got.values() and "m1" in got.values()
    text = {r.query_id: r.text for r in rendered(hits, engine.chunks).collect()}
    assert text[1].startswith("**Result 1** [API] | a.b.Square | score 1.0000")
    assert '"id":"a.b.Square"' in as_json(hits, engine.chunks).where("query_id = 1 AND pos = 0").first().json
    assert engine.single(asked, "api", kind="class_overview").count() >= 2 and engine.dashboard(asked, "mod").first().chunk_id == "m1"


def test_records(spark, tmp_path):
    from corvane.sources import records

    meta = spark.createDataFrame([("api", 1), ("mod", 2)], "collection string, repo_count int")
    changed = spark.createDataFrame([("mod", 3)], "collection string, repo_count int")
    assert sorted(tuple(r) for r in records.merge_meta(meta, changed).collect()) == [("api", 1), ("mod", 3)]
    assert records.version_record(spark, "v1", "lite").first().tier == "lite"
    (tmp_path / "release.json").write_text('{"tag_name": "v1",\n "assets": [{"name": "data-a.zip", "size": 5}, {"name": "x", "size": 1}]}')
    assert [(r.tag, r.name, r.size) for r in store.tier_assets(records.release_assets(spark, str(tmp_path / "release.json")), "data-", "full").collect()] == [("v1", "data-a.zip", 5)]
    root = str(tmp_path / "skills")
    assert records.write_skill(spark, root, "My ../Skill", "text\nmore") == "myskill"
    assert records.read_skill(spark, root, "mySkill") == "text\nmore" and records.read_skill(spark, root, "..") is None
    assert not records.delete_skill(spark, root, "../..") and records.delete_skill(spark, root, "myskill") and not records.delete_skill(spark, root, "myskill")
    with pytest.raises(ValueError):
        records.write_skill(spark, root, "../", "x")


def test_embedding_and_dense_search(spark):
    from corvane.operators import dense
    from corvane.sources.embedding import QUERY_PREFIX, embed, other_models

    letters = lambda texts: [[float(t.split(": ")[1].count(c)) for c in "abc"] for t in texts]
    chunks = spark.createDataFrame([("x", "aab"), ("y", "bbc"), ("z", ""), ("n", None)], "chunk_id string, body string")
    asked = embed(spark.createDataFrame([(1, "ab"), (2, "c")], "query_id int, query string"), "query_id", "query", letters, QUERY_PREFIX).withColumnRenamed("embedding", "vector")
    hits = dense.vector_search(embed(chunks, "chunk_id", "body", letters), asked, 2).orderBy("query_id", "pos").collect()
    assert [(r.query_id, r.chunk_id) for r in hits] == [(1, "x"), (1, "y"), (2, "y"), (2, "x")]
    assert abs(hits[0].distance - (1 - 3 / (5**0.5 * 2**0.5))) < 1e-8
    assert other_models(spark.createDataFrame([("api", "m1"), ("mod", None)], "collection string, embed_model string"), "m2").first().collection == "api"


def test_stream_refresh(spark, tmp_path, classes):
    from corvane.streaming.refresh import refresh, refreshed

    classes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in"))
    refresh(stream, str(tmp_path / "out"), str(tmp_path / "state"), ("class_name",)).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == classes.count()
    asked = spark.createDataFrame([(1, "Square")], "query_id int, query string")
    hits = keyword.keyword_search(refreshed(spark, str(tmp_path / "out")), asked, 3).collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in hits] == [(r.chunk_id, round(r.score, 6)) for r in keyword.keyword_search(keyword.Index.of(classes, ("class_name",)), asked, 3).collect()] and hits


def test_stored_index(spark, tmp_path, classes):
    """A stored index answers as one computed on the way, by five fields and stems, with few terms and with many."""
    from corvane.operators import blocks

    rows = classes.withColumn("body", F.concat_ws(" ", "class_name", "method_name", F.lit("running shapes")))
    fields = ("chunk_id", "fqn", "class_name", "method_name", "body")
    index = keyword.Index.of(rows, fields, "porter")
    asked = spark.createDataFrame([(1, "runs a.b.Square"), (2, "shape Node1"), (3, ""), (4, "shape shape nothing.here")], "query_id int, query string")
    got = lambda i, n=5, **o: sorted(map(tuple, keyword.keyword_search(i, asked, n, **o).select("query_id", "source", "chunk_id", "score", "pos").collect()))
    want, sizes = got(index), (blocks.RANGE_CHUNKS, blocks.FIRST_RANGES, blocks.FEW_RANGES, keyword.FEW_TERMS, keyword.FEW_PHRASES)
    known = rows.where(F.col("class_name").startswith("N")).select("chunk_id")
    few = got(index, 3, known=known)
    assert want and few
    try:
        for i, (size, first, ranges, terms, phrases) in enumerate([sizes, (3, 1, 1000, 1000, 10_000), (2, 1, 1, 0, 0), (4, 2, 1000, 0, 10_000)]):
            blocks.RANGE_CHUNKS, blocks.FIRST_RANGES, blocks.FEW_RANGES, keyword.FEW_TERMS, keyword.FEW_PHRASES = size, first, ranges, terms, phrases
            stored = blocks.BlockIndex.write(rows, str(tmp_path / f"index{i}"), fields, "porter")
            assert got(stored) == want and got(stored, 3, known=known) == few
    finally:
        blocks.RANGE_CHUNKS, blocks.FIRST_RANGES, blocks.FEW_RANGES, keyword.FEW_TERMS, keyword.FEW_PHRASES = sizes
    assert got(stored.only("guide")) == [] and stored.only("guide").blocks.count() == 0


def test_blocks_that_cannot_win_are_not_scored(spark, tmp_path):
    """The ranges that hold the best chunks are scored, ranges below their scores are not; ties and added batches stay right."""
    from corvane.operators import blocks

    texts = [(f"c{i:04}", "api", ("door " * (1 + 30 * (i < 12)) + f"word{i} other " * (3 if i < 12 else 40))) for i in range(400)] + [("null", "api", None)]
    chunks = spark.createDataFrame(texts, "chunk_id string, source string, body string").coalesce(1)
    asked = spark.createDataFrame([(1, "door"), (2, "door.word7"), (3, "other")], "query_id int, query string")
    got = lambda i: sorted(map(tuple, keyword.keyword_search(i, asked, 5, keyword.whole_phrases).select("query_id", "chunk_id", "score", "pos").collect()))
    want, scored, size = got(keyword.Index.of(chunks)), [], blocks.RANGE_CHUNKS
    real = blocks.BlockIndex._scores
    try:
        blocks.RANGE_CHUNKS = 10
        one = blocks.BlockIndex.write(chunks, str(tmp_path / "one"))
        blocks.BlockIndex._scores = lambda self, ranges, *a: (scored.append(ranges.where("query_id = 1").count()), real(self, ranges, *a))[1]
        assert got(one) == want and one.docs.count() == 41 and sum(scored) <= 3
        blocks.BlockIndex._scores = real
        for name, part in (("a", "chunk_id < 'c02'"), ("b", "chunk_id >= 'c02'")):
            blocks.BlockIndex.write(chunks.where(part), str(tmp_path / name))
        assert got(blocks.BlockIndex.read(spark, [str(tmp_path / "a"), str(tmp_path / "b")])) == want
    finally:
        blocks.RANGE_CHUNKS, blocks.BlockIndex._scores = size, real
    none = blocks.BlockIndex.write(chunks.limit(0), str(tmp_path / "none"))
    assert got(none) == []


def test_vector_index(spark, tmp_path):
    """Probes find nine of ten neighbours and read few files; the exact search equals the exhaustive one; odd rows are kept."""
    import numpy as np
    from corvane.operators import dense, vector_index

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    points = centres[rng.integers(0, 20, 3000)] + 0.35 * rng.normal(size=(3000, 16))
    rows = [(i, p.tolist(), i % 3) for i, p in enumerate(points)] + [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [1.0], 0)] + [(6000 + i, points[0].tolist(), 0) for i in range(30)]
    vectors = spark.createDataFrame(rows, "chunk_id int, embedding array<float>, label int")
    asked = spark.createDataFrame([(i, points[i].tolist()) for i in range(0, 3000, 60)] + [(9001, [0.0] * 16), (9002, None), (9003, [1.0])], "query_id int, vector array<float>")
    index = vector_index.VectorIndex.write(vectors, str(tmp_path / "v"), lists=25, sample=1500)
    assert index.rows.count() == len(rows) and index.rows.where("__list = -1").count() == 3 and index.probes < 12
    exact = dense.vector_search(vectors, asked, 10)
    found = index.search(asked, 10)
    assert dense.recall_at(found, exact.select("query_id", "chunk_id"), 10).agg(F.avg("recall")).first()[0] >= 0.9
    key = lambda d: sorted((r.query_id, r.chunk_id, r.similarity, r.pos) for r in d.collect())
    assert key(index.search(asked, 10, exact=True)) == key(exact) == key(index.search(asked, 10, probes=25))
    assert key(index.search(asked, 4, exact=True, where=F.col("label") == 1)) == key(dense.vector_search(vectors, asked, 4, F.col("label") == 1))
    unit = vector_index._unit(points[:1])
    lists = index.lists_of(unit, 2)
    plan = index._scan(unit, lists, 5, None)._jdf.queryExecution().executedPlan().toString()
    read = index.rows.where(F.col("__list").isin(lists[0].tolist())).select(F.input_file_name()).distinct().count()
    assert re.search(r"PartitionFilters: \[[^]]*__list", plan) and read == 2 < len(index.rows.inputFiles())
    block = vector_index.BLOCK_QUERIES
    try:
        vector_index.BLOCK_QUERIES = 9
        assert key(index.search(asked, 10, exact=True)) == key(exact)
    finally:
        vector_index.BLOCK_QUERIES = block
    none = vector_index.VectorIndex.write(vectors.limit(0), str(tmp_path / "none"))
    assert none.search(asked, 3, exact=True).count() == 0


def test_rows_of_the_index(spark):
    hits = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, pos int")
    rows = [("a", "x.A", "A", None, "stored"), ("b", "x.B", "B", None, "kept")]
    table = spark.createDataFrame(rows, "chunk_id string, fqn string, class_name string, method_name string, body string")
    got = fusion.with_rows(hits, table.where("chunk_id = 'a'"), table.withColumn("body", F.lit("kept"))).orderBy("pos").collect()
    assert [(r.chunk_id, r.body, r.from_index) for r in got] == [("a", "stored", False), ("b", "kept", True)]


def test_lists_are_pruned(spark, classes):
    rows = [("p", f"C{i:02}") for i in range(25)] + [("q", "A"), ("q", "A"), ("q", None)]
    got = {r.package: r for r in graph.packages(spark.createDataFrame(rows, "package string, class_name string"), 3).collect()}
    assert got["p"].shown == ["C00", "C01", "C02"] and got["p"].classes == 25 and got["q"].classes == 3 and got["q"].shown == ["?", "A", "A"] and got["q"].more == 0
    assert diff.compared(None, classes) == (None, diff.NO_SNAPSHOT)
    text = {r.query_id: r.text for r in graph.class_report(classes, names(spark, "Node0", "Squar")).collect()}
    assert "### Inherited Methods" in text[0] and "// inherited from a.b.Node1" in text[0] and "Did you mean:" in text[1] and "a.b.Square" in text[1]


def test_metadata_conditions(spark):
    rows = spark.createDataFrame([(str(i), "ab"[i % 2] if i % 5 else None, i) for i in range(20)], "chunk_id string, kind string, n int")
    assert store.get(rows, isin={"n": [1, 2, 30]}).count() == 2 and store.get(rows, where={"kind": ""}).count() == 4
    assert store.get(rows, differs={"kind": "a"}).count() == 12 and store.get(rows, differs={"kind": ""}).count() == 16
    assert [r.n for r in store.get(rows, at_least={"n": 3}, below={"n": 8}, offset=1, limit=2).collect()] == [4, 5]


def test_vectors_of_no_length(spark):
    """Rows and queries without length, of another width, with nulls or null have no similarity; ties go by id."""
    from corvane.operators import dense

    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 1.0]), (7, [None, 1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id int, vector array<float>")
    got = [(r.query_id, r.chunk_id, r.similarity, r.pos) for r in dense.vector_search(vectors, asked, 2).orderBy("pos").collect()]
    assert got == [(1, 1, 1.0, 0), (1, 2, 1.0, 1)]
    step, block = dense.STEP_QUERIES, dense.BLOCK_QUERIES
    many = spark.range(50).select(F.col("id").alias("query_id"), F.array(F.cos(F.col("id").cast("double")), F.sin(F.col("id").cast("double"))).alias("vector"))
    held = many.select(F.col("query_id").alias("chunk_id"), F.col("vector").alias("embedding"))
    want = sorted(map(tuple, dense.vector_search(held, many, 3).collect()))
    try:
        dense.STEP_QUERIES, dense.BLOCK_QUERIES = 7, 20
        assert sorted(map(tuple, dense.vector_search(held, many, 3).collect())) == want and len(want) == 150
    finally:
        dense.STEP_QUERIES, dense.BLOCK_QUERIES = step, block
    assert dense.vector_search(vectors, asked.limit(0), 2).count() == 0
