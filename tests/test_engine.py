"""An index of a small tree, end to end: scan, parse, query, incremental runs, storage, workspace, export and streaming."""

import json
import os
import random
import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from lexiloom import functions as fn
from lexiloom import sources
from lexiloom.engine import Engine, Index, build_index, merge_roots
from lexiloom.operators.callgraph import CallGraph
from lexiloom.operators.deps import cycle_heads, cycle_members, has_cycle_from
from lexiloom.operators.search import query_tokens
from lexiloom.streaming.watch import debounced, replay, watch

FILES = {
    "src/engine.rs": "use crate::utils::scale;\n/// Runs.\npub struct Engine { rate: u32 }\nimpl Engine {\n    pub fn run(&self) { scale(1.0); }\n}\n",
    "src/utils.rs": "pub fn scale(x: f32) -> f32 { x }\n",
    "src/main.rs": "use crate::engine::Engine;\nfn main() { run(); }\nfn run() { scale(2.0); }\n",
    "gen/skip.rs": "fn skipped() {}\n",
    ".gitignore": "gen/\n",
    "broken.py": "def (\n",
    "notes.txt": "nothing",
}


@pytest.fixture()
def tree(tmp_path):
    for p, t in FILES.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    return tmp_path


def test_end_to_end(spark, tree, tmp_path):
    ix = build_index(spark, str(tree))
    assert (ix.meta["scanned"], ix.meta["parsed"], ix.meta["failed"], ix.meta["truncated"]) == (4, 3, 1, 0)
    assert ix.meta["failures"][0]["file_path"] == "broken.py"
    e = Engine(ix)
    assert {r["name"] for r in e.callers("scale").collect()} == {"run"}
    assert e.search("engine").first()["name"] == "Engine"
    assert e.refs("scale", "call").count() == 2
    assert {(r[0], r[1]) for r in e.deps().collect()} == {("src/engine.rs", "src/utils.rs"), ("src/main.rs", "src/engine.rs")}
    assert e.impact("scale").first()["transitive_callers"] == 2
    assert e.path("main", "scale").first()["hops"] == 2
    answer = json.loads(e.handle('{"jsonrpc":"2.0","id":1,"method":"symbol","params":{"name":"Engine"}}'))
    assert answer["id"] == 1 and answer["result"][0]["kind"] == "struct"
    assert json.loads(e.handle("{"))["error"]["code"] == -32700
    assert json.loads(e.handle("{}"))["error"]["code"] == -32600
    assert e.call("nothing")["error"]["code"] == -32601
    assert e.call("refs", {})["error"]["code"] == -32602
    ix.write(str(tmp_path / "ix"))
    again = Index.read(spark, str(tmp_path / "ix"))
    assert again.symbols.count() == ix.symbols.count()
    e.export_sqlite(str(tmp_path / "x.db"))
    db = sqlite3.connect(tmp_path / "x.db")
    assert db.execute("select count(*) from symbols").fetchone()[0] == ix.symbols.count()
    same = build_index(spark, str(tree), previous=again)
    assert (same.meta["parsed"], same.meta["skipped"]) == (0, 3)
    os.utime(tree / "src/utils.rs", ns=(1, 1))
    (tree / "src/main.rs").write_text("fn main() {}\n")
    next_ = build_index(spark, str(tree), previous=again)
    assert (next_.meta["parsed"], next_.meta["skipped"]) == (1, 2)
    assert next_.symbols.where("name = 'run' and kind = 'function'").count() == 0
    assert build_index(spark, str(tree), max_files=1).meta["truncated"] == 3
    assert build_index(spark, str(tree), respect_gitignore=False).meta["scanned"] == 5
    both = merge_roots({"a": ("1", ix), "b": ("2", next_)})
    assert both.symbols.where("id like '[a]src/engine.rs::Engine#%'").count() == 1
    with pytest.raises(ValueError):
        Engine(both).export_sqlite(str(tmp_path / "y.db"))


def test_git(spark, tree):
    def git(*a):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(tree), *a], check=True, capture_output=True)

    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    (tree / "src/utils.rs").write_text("pub fn scale(x: f32) -> f32 { x * 2.0 }\n")
    git("commit", "-qam", "second")
    e = Engine(build_index(spark, str(tree)))
    assert [(r["name"], r["change"]) for r in e.diff(str(tree), "HEAD~1", "HEAD").collect()] == [("scale", "Modified")]
    from lexiloom.operators.changes import blame_lines

    rows = blame_lines(sources.git_blame(spark, str(tree), "src/engine.rs", 1, 3)).orderBy("line").collect()
    assert [r["line"] for r in rows] == [1, 2, 3] and {r["summary"] for r in rows} == {"first"}


def test_graph_shapes(spark):
    g = CallGraph(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x::d", "c"), ("a", "b"), (None, "b")], "caller string, callee string"))
    assert {r["name"] for r in g.callers("c").collect()} == {"b", "x::d"}
    assert {(r[0], r[1]) for r in g.transitive("c").collect()} == {("b", 1), ("x::d", 1), ("a", 2)}
    assert g.has_cycle("a") and not g.has_cycle("x::d")
    assert g.path("d", "b").first()["path"] == ["x::d", "c", "b"] or g.path("d", "b").first()["hops"] == 2
    assert g.path("a", "a").first()["hops"] == 0 and g.path("a", "nobody").count() == 0
    empty = CallGraph(spark.createDataFrame([], "caller string, callee string"))
    assert empty.impact("a").first()["transitive_callers"] == 0


@pytest.mark.parametrize(("edges", "members", "heads"), [("ab bc", "", []), ("ab ba", "ab", ["a"]), ("ab bc ca cd de ed", "abcde", ["a"]), ("aa bc", "a", ["a"]), ("za ab ba bc cd dc", "abcd", ["a"]), ("", "", [])])
def test_dependency_cycles(spark, edges, members, heads):
    e = spark.createDataFrame([tuple(x) for x in edges.split()], "src_file string, dst_file string")
    assert {r["file"] for r in cycle_members(e).collect()} == set(members)
    assert cycle_heads(e) == heads
    if members:
        assert has_cycle_from(e, members[0])


@pytest.mark.parametrize(("text", "tokens"), [("processAudioBlock", "process audio block"), ("AudioEngine", "audio engine"), ("process_audio_block", "process audio block"), ("HTTPClient", "http client"), ("getHTTPResponse", "get http response"), ("process audio", "process audio"), ("a.b/cd", "cd")])
def test_code_tokens(spark, text, tokens):
    assert spark.range(1).select(fn.code_tokens(F.lit(text))).first()[0] == tokens.split()
    assert sum(query_tokens(text), []) == tokens.split()


def test_diff_ranges_and_candidates(spark):
    lines = ["@@ -1 +5,3 @@", "@@ -1,2 +7 @@", "@@ -1 +9,0 @@", "@@ -1 +0,0 @@", "text"]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").orderBy("i").select(fn.diff_range("x")).collect()]
    assert got == [(5, 7), (7, 7), (9, 9), None, None]


def test_streams(spark, tmp_path):
    rows = [(0, "a.rs"), (200, "b.rs"), (400, "a.rs"), (1500, "c.rs")]
    e = spark.createDataFrame(rows, "ms long, path string").select(F.timestamp_millis("ms").alias("ts"), "path")
    bursts = debounced(e, watermark=None).orderBy("first_ms").collect()
    assert [(r["first_ms"], r["events"], sorted(r["changed"])) for r in bursts] == [(0, 3, ["a.rs", "b.rs"]), (1500, 1, ["c.rs"])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"path": "a.rs"}\n{"path": "a.rs"}\n{"path": "x.txt"}\n')
    seen = []
    q = watch(spark.readStream.schema("path string").json(str(tmp_path / "in")), lambda df, n: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "cp"), "100 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert seen == ["a.rs"]


def test_replay_ends_its_bursts(spark, tmp_path):
    times = [("a", 0), ("a", 5), ("b", 7), ("a", 40), ("b", 90), ("a", 91), ("a", 99)]
    rows = [(f"2024-01-01 {m // 60:02}:{m % 60:02}:00", i, t) for i, (t, m) in enumerate(times)]
    e = spark.createDataFrame(rows, "ts string, user_id long, event_type string").selectExpr("cast(ts as timestamp_ntz) as ts", "user_id", "event_type")
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["event_type"], r["events"]) for r in replay(spark, f"{tmp_path}/events.parquet/{next(tmp_path.glob('events.parquet/*.parquet')).name}").collect())
    assert got == [("a", 1), ("a", 2), ("a", 2), ("b", 1), ("b", 1)]
    e.limit(0).coalesce(1).write.parquet(f"{tmp_path}/none.parquet")
    assert replay(spark, f"{tmp_path}/none.parquet/{next(tmp_path.glob('none.parquet/*.parquet')).name}").count() == 0


def test_small_and_large_graphs_agree(spark, monkeypatch):
    """The driver's arrays and the joins of frontiers give the same, by exact, short and partial names."""
    import random

    from lexiloom.operators import callgraph

    r = random.Random(2)
    names = [f"m{i % 5}::f{i}" for i in range(40)] + ["a::f3", "loop"]
    edges = spark.createDataFrame([(r.choice(names), r.choice(names)) for _ in range(70)] + [("loop", "loop"), (None, "x"), ("m0::f0", "far"), ("island", "isle")], "caller string, callee string")
    small = CallGraph.stored(edges)
    monkeypatch.setattr(callgraph, "LOCAL_EDGES", 0)
    large = CallGraph.stored(edges)
    assert small.local is not None and large.local is None and small.most_called == large.most_called
    rows = lambda df: sorted(map(tuple, df.collect()))
    for n in ("m0::f0", "f3", "f1", "loop", "nothing"):
        assert rows(small.callers(n)) == rows(large.callers(n)) and rows(small.callees(n)) == rows(large.callees(n))
    for n in ("m1::f1", "loop", "nothing"):
        assert rows(small.transitive(n)) == rows(large.transitive(n))
        assert small.has_cycle(n) == large.has_cycle(n)
    for n in ("m1::f1", "f3"):
        assert rows(small.transitive(n, 2, "callees")) == rows(large.transitive(n, 2, "callees"))
    assert rows(small.impact("m1::f1")) == rows(large.impact("m1::f1"))
    for a, z in (("m0::f0", "m3::f8"), ("far", "loop"), ("m1::f1", "m1::f1"), ("island", "loop"), ("x", "nothing")):
        one, two = small.path(a, z).collect(), large.path(a, z).collect()
        assert [x["hops"] for x in one] == [x["hops"] for x in two]
        link = {(x["caller"], x["callee"]) for x in edges.collect()}
        assert all((p, q) in link or (q, p) in link for x in one for p, q in zip(x["path"], x["path"][1:]))


def test_degraded_files(spark):
    from lexiloom.extract import parse_files

    files = spark.createDataFrame([("a.py", "class A:\n    def run(self):\n        pass\ndef broken(:\n"), ("b.py", "((("), ("c.py", "x = 1\n"), ("d.py", None)], "file_path string, content string")
    got = {r["file_path"]: (r["status"], [(s["name"], s["kind"], s["span"]["start_line"]) for s in r["symbols"]]) for r in parse_files(files).collect()}
    assert got["a.py"] == ("degraded", [("A", "class", 1), ("run", "method", 2), ("broken", "function", 4)])
    assert got["b.py"] == ("failed", []) and got["c.py"][0] == "parsed" and got["d.py"] == ("failed", [])


def test_store_scan_counts_what_it_leaves(spark, tree):
    files, left = sources.scan_store(spark, f"file://{tree}")
    assert left == 0 and {r["file_path"] for r in files.select("file_path").collect()} == {"src/engine.rs", "src/utils.rs", "src/main.rs", "gen/skip.rs", "broken.py"}
    files, left = sources.scan_store(spark, f"file://{tree}", 2)
    assert left == 3 and [r["file_path"] for r in files.select("file_path").orderBy("file_path").collect()] == ["broken.py", "gen/skip.rs"]


def test_index_versions(spark, tree, tmp_path):
    """A reader of the version before still reads it after one write more; stored search gives what search on symbols gives."""
    ix = build_index(spark, str(tree))
    assert ix.meta["degraded"] == 0
    for _ in range(3):
        ix.write(str(tmp_path / "ix"))
    old = Index.read(spark, str(tmp_path / "ix"))
    ix.write(str(tmp_path / "ix"))
    assert old.symbols.count() == ix.symbols.count() and len(list((tmp_path / "ix").glob("v*"))) == 2
    assert Index.read(spark, str(tmp_path / "none")) is None
    from lexiloom.operators import search

    rows = lambda df: [(r["id"], r["score"]) for r in df.collect()]
    assert rows(Engine(old).search("run")) == rows(search.search(ix.symbols, "run")) != []


def test_file_keys_and_lines(spark):
    files = spark.createDataFrame([("a.rs", "one", "x\ny"), ("a.rs", "two", "z")], "file_path string, label string, content string")
    assert [r["text"] for r in sources.line_range(files, "[one]a.rs", 1, 9).collect()] == ["x", "y"]
    assert sources.line_range(files, "a.rs", 1, 1).count() == 2 and sources.line_range(files, "a.rs", 7, 9).count() == 0


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from lexiloom import durable

    class Conf:
        def get(self, key, default):
            return default

    class Fake:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        durable.shared_dir(Fake())


def test_bursts_by_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(-40_000, 40_000) * 100, rnd.randrange(9)) for _ in range(1500)] + [("tie", 0, 1), ("tie", 500_000, 2), ("tie", 999_999, 2), ("none", 5, None)]
    want = []
    for k in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == k)
        burst = [own[0]]
        for x in own[1:] + [None]:
            if x is None or x[0] - burst[-1][0] >= 500_000:
                want.append((str(k), burst[0][0] // 1000, burst[-1][0] // 1000, len(burst), sorted({p for _, p in burst} - {None})))
                burst = []
            burst.append(x)
    e = spark.createDataFrame(rows, "k string, us long, path int").withColumn("ts", F.timestamp_micros("us"))
    got = debounced(e, keys=["k"], watermark=None)
    assert sorted((str(r["k"]), r["first_ms"], r["last_ms"], r["events"], sorted(r["changed"])) for r in got.collect()) == sorted(want)
    assert "MergingSessions" not in got._jdf.queryExecution().toString()
    counts = debounced(e, keys=["k"], watermark=None, paths=False)
    assert sorted((str(r["k"]), r["first_ms"], r["events"], r["files"]) for r in counts.collect()) == sorted((k, a, n, len(p)) for k, a, _, n, p in want)


def test_postings_count_in_rows_and_spread_a_term(spark):
    from collections import Counter

    from lexiloom.operators import search

    texts = {1: "get_item getItem x_get", 2: "", 3: "a b c", 4: "item"}
    docs = spark.createDataFrame(list(texts.items()), "id long, body string")
    made = search.postings(search.tokenized(docs, "id", ["body"]))
    want = [(k, t, n, sum(c.values())) for k, c in ((k, Counter(t for w in query_tokens(x) for t in w)) for k, x in texts.items()) for t, n in c.items()]
    assert sorted((r["id"], r["term"], r["tf"], r["len"]) for r in made.collect()) == sorted(want)
    assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()
    many = search.tokenized(spark.range(20_000).select("id", F.lit("common").alias("body")), "id", ["body"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in search.by_term(search.postings(many)).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 15_000


def test_identifier_index_shuffles_once(spark, tmp_path):
    from lexiloom.operators import symbols
    from lexiloom.plans import bindings

    ids = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", "x"), ("a", "y")], "file_path string, name string")
    made = symbols.identifier_index(ids)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r["name"]: r["files"] for r in made.collect()} == {"x": ["a", "b"], "y": ["a"]}
    docs = [(1, "getItem\nItem get\n\nHTTPServer x", "en", "s"), (1, "item camel\nCase", "en", "s"), (2, None, "en", "s"), (3, "a\nBB", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = lambda df: sorted({(r["file_path"], r["name"]) for r in df.collect()})
    assert pairs(bindings.identifier_files(spark, str(tmp_path))) == pairs(bindings.identifiers(spark, str(tmp_path)))


def test_tables_by_keys_are_those_of_the_sql(spark, tmp_path):
    from lexiloom.plans import bindings as b

    d = str(tmp_path)
    parts = [(k, n, br, t, 5) for k, n, br, t in [(1, "red bolt", "Brand#11", "STEEL"), (2, "red nut", "Brand#12", "TIN"), (3, "blue bolt", "Brand#13", "STEEL"), (3, "blue bolt", "Brand#13", "STEEL"), (3, "blue nail", "Brand#14", "TIN"), (4, None, "Brand#15", "TIN"), (5, "saw", "Brand#16", None), (6, "pin", "Brand#17", "TIN")]]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(d + "/part.parquet")
    lines = [(o, k, 1, n, 1.0, 1.0) for o, ks in enumerate([[1, 2, 3, 1], [2, 2, 3], [1, 2], [4, 1, 5, 6], [3, 5, 99, 1], [6]]) for n, k in enumerate(ks)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(d + "/lineitem.parquet")
    rows = lambda df: sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    assert rows(b.call_edges(spark, d)) == rows(b.bound(spark, d, b.CALL_EDGES).where("caller is not null and callee is not null"))
    want = b.bound(spark, d, b.IMPORTS)
    assert rows(b.imports(spark, d)) == rows(want) and len(rows(want)) > 5
    assert rows(b.file_imports(spark, d)) == rows(want.select("file_path", "module_path").distinct())
    for made in (b.call_edges, b.imports, b.file_imports):
        assert "Broadcast" not in made(spark, d)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("edges, met", [([("t", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "t"), ("x", "t")], True), ([("t", "a"), ("a", "b"), ("b", "a"), ("x", "t")], False), ([("t", "t"), ("x", "t")], True), ([("x", "t")], False), ([("t", "a"), ("a", "t"), ("x", "a")], True)])
def test_impact_of_a_large_graph(spark, monkeypatch, edges, met):
    from lexiloom.operators import callgraph

    table = spark.createDataFrame(edges, "caller string, callee string")
    want = CallGraph.stored(table).impact("t").collect()
    monkeypatch.setattr(callgraph, "LOCAL_EDGES", 0)
    g = CallGraph.stored(table)
    walks = []
    monkeypatch.setattr(g, "has_cycle", lambda t: walks.append(t))
    assert g.impact("t").collect() == want and want[0]["in_cycle"] == met
    assert not walks and list(g.found) == ["t"]  # the walk down is used again, the name is looked up once


def test_deps_queries_make_one_row_a_pair_of_files(spark, monkeypatch):
    """The join of lines runs once in each query, on pairs of files, and broadcasts no table of parts."""
    from lexiloom.plans import catalog

    d = os.environ.get("LEXILOOM_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(d):
        pytest.skip("no tables")
    stored = []
    real = catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df, tag: stored.append((tag, df)) or real(df, tag))
    for name in ("deps_edges", "deps_dependents", "deps_dependencies", "deps_modules", "deps_cycle_members", "deps_mermaid"):
        stored.clear()
        plan = catalog.QUERIES[name](spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "lineitem" not in plan and "l_partkey" not in plan
        imports = [df for tag, df in stored if tag == "imports"]
        assert len(imports) == 1 and imports[0].columns == ["file_path", "module_path"]
        assert "Broadcast" not in imports[0]._jdf.queryExecution().executedPlan().toString()
