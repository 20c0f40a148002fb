"""Hand-built graphs with answers known by hand."""

import random

import pytest

from graphloom.graph import SymbolGraph
from graphloom.operators import health, impact, link, lookup, order, render, sets, traverse
from graphloom.sources import evidence, gitlog, graphfile
from graphloom.streaming import refresh


def make(spark, nodes, edges):
    n = spark.createDataFrame([(i, id_, id_.split(":", 1)[0], name, q, file, line, "pub", f"fn {name}()", None, 0) for i, (id_, name, q, file, line) in enumerate(nodes)], "ord long, id string, kind string, name string, qualified_name string, file string, start_line long, visibility string, signature string, docs string, lines long")
    e = spark.createDataFrame([(i, a, b, k, 1, "ast", "definite", s) for i, (a, b, k, s) in enumerate(edges)], "ord long, src string, dst string, kind string, weight long, source string, certainty string, call_style string")
    return SymbolGraph(n, e)


@pytest.fixture(scope="module")
def ambiguous(spark):
    f = "function:demo::"
    return make(spark, [(f + "index", "index", "demo::index", "src/main.rs", 10), (f + "analyzer::index", "index", "demo::analyzer::index", "src/analyzer.rs", 30), (f + "helper", "helper", "demo::helper", "src/main.rs", 50)], [(f + "index", f + "helper", "calls", None)])


@pytest.fixture(scope="module")
def risky(spark):
    names = [("caller_a", "src/a.rs"), ("caller_b", "src/b.rs"), ("caller_c", "src/c.rs"), ("target_fn", "src/target.rs"), ("dep1", "src/dep.rs"), ("dep2", "src/dep.rs")]
    f = "function:"
    calls = [("caller_a", "target_fn", "direct"), ("caller_b", "target_fn", "direct"), ("caller_c", "target_fn", "method"), ("target_fn", "dep1", None), ("target_fn", "dep2", None)]
    return make(spark, [(f + n, n, n, file, 1) for n, file in names], [(f + a, f + b, "calls", s) for a, b, s in calls])


def test_lookup_prefers_exact_names(ambiguous):
    assert [r.qualified_name for r in lookup.find_nodes(ambiguous, "index").collect()] == ["demo::index", "demo::analyzer::index"]
    assert lookup.require_unique(ambiguous, "demo::index")["id"] == "function:demo::index"
    assert lookup.require_unique(ambiguous, "analyzer::index")["id"] == "function:demo::analyzer::index"
    with pytest.raises(lookup.Ambiguous, match="demo::analyzer::index"):
        lookup.require_unique(ambiguous, "index")
    with pytest.raises(lookup.NotFound, match="helper"):
        lookup.require_unique(ambiguous, "helpre")


def test_modules(spark):
    g = make(
        spark,
        [("file:src/main.rs", "src/main.rs", "src/main.rs", "src/main.rs", 1), ("module:demo", "demo", "demo", "src/main.rs", 1), ("module:demo::model", "model", "demo::model", "src/main.rs", 12), ("module:demo::model#2", "demo::model", "demo::model", "src/model.rs", 1), ("function:demo::main_fn", "main_fn", "demo::main_fn", "src/main.rs", 3), ("struct:demo::App", "App", "demo::App", "src/main.rs", 5), ("struct:demo::model::Node", "Node", "demo::model::Node", "src/model.rs", 2)],
        [("file:src/main.rs", "module:demo", "module_file", None), *(("module:demo", x, "declares", None) for x in ("module:demo::model", "function:demo::main_fn", "struct:demo::App")), ("module:demo::model#2", "struct:demo::model::Node", "declares", None)],
    )
    assert lookup.scope_file(g, "src/main.rs").count() == 3
    assert [r.id for r in lookup.scope_module(g, "demo::model").collect()] == ["struct:demo::model::Node"]


def test_impact_risk(risky, ambiguous):
    r = impact.impact(risky, "function:target_fn").risk.first()
    assert (r.files, r.sites, r.score, r.level) == (3, 3, 17, "critical")
    r = impact.impact(ambiguous, "function:demo::analyzer::index").risk.first()
    assert (r.score, r.level) == (0, "low")
    assert any("file" in h for h in impact.hints("critical", 3, 3, True, True, 2))


def fifo(adj, start, depth, limit, keep):
    """The queue that a walk stands for."""
    seen, out, queue = {start} if keep else set(), [], [(start, 0)]
    while queue:
        node, level = queue.pop(0)
        if level >= depth or len(out) >= limit:
            continue
        for nxt in adj.get(node, []):
            if nxt not in seen:
                seen.add(nxt)
                out.append((nxt, level + 1, node))
                queue.append((nxt, level + 1))
    return out


@pytest.mark.parametrize("seed,limit,keep", [(1, 3, True), (2, 5, False), (3, 100, False)])
def test_walk_equals_a_queue(spark, seed, limit, keep):
    r = random.Random(seed)
    ids = [f"function:n{i}" for i in range(12)]
    pairs = list(dict.fromkeys((r.choice(ids), r.choice(ids)) for _ in range(30)))
    g = make(spark, [(i, i, i, "f.rs", 1) for i in ids], [(a, b, "calls", None) for a, b in pairs])
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, []).append(b)
    start = pairs[0][0]
    found = traverse.walk(g, start, "out", ("calls",), 3, limit, keep).where("depth > 0").orderBy("depth", "rank").collect()
    assert [(x.id, x.depth, x.parent) for x in found] == fifo(adj, start, 3, limit, keep)


@pytest.mark.parametrize("seed", [4, 5])
def test_walks_by_shuffle_equal_walks_by_broadcast(spark, seed):
    r = random.Random(seed)
    pairs = [("n0", f"n{r.randrange(30)}") for _ in range(40)] + [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(60)]
    steps = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "node string, next string, edge_ord long")
    seeds = spark.createDataFrame([("n0",), ("n5",)], "seed string")
    known = spark.createDataFrame([(f"n{i}",) for i in range(28)], "node string")
    for limit in (None, 7):
        one, other = (sorted(map(tuple, traverse.bfs(steps, seeds, 3, limit, False, known, held).collect())) for held in (1000, 0))
        assert one == other and one


@pytest.mark.parametrize("held", [0, 1000])
def test_levels_of_long_chains_and_cycles(spark, held):
    pairs = [(str(i), str(i + 1)) for i in range(12)] + [("a", "b"), ("b", "c"), ("c", "b"), ("x", "3"), ("q", None), ("z", "z"), ("x", "3")]
    got = {r.id: r.level for r in order.topo_levels(spark.createDataFrame(pairs, "f string, t string"), held).collect()}
    assert got == {str(i): 12 - i for i in range(13)} | {"x": 10}
    assert order.topo_levels(spark.createDataFrame([], "f string, t string"), held).count() == 0


def test_paths_and_orders(spark, risky):
    assert [r.id for r in traverse.shortest_path(risky, "function:caller_a", "function:dep2").orderBy("position").collect()] == ["function:caller_a", "function:target_fn", "function:dep2"]
    assert traverse.shortest_path(risky, "function:dep1", "function:dep2").count() == 0
    assert traverse.shortest_path(risky, "function:dep1", "function:dep1").count() == 1
    steps, cycles, missing = order.refactor_order(risky, ["target_fn", "caller_a", "dep1", "nothing"])
    assert [r.id for r in steps.orderBy("step").collect()] == ["function:dep1", "function:target_fn", "function:caller_a"] and missing == ["nothing"] and not cycles
    assert order.components({"a": {"b"}, "b": {"a"}, "c": {"c"}, "d": {"a"}}) == [["a", "b"], ["c"]]
    pairs = [(str(a), str(b)) for a in range(8) for b in range(a) if (a * b) % 3 == 1] + [("x", "y"), ("y", "x")]
    level = {r.id: r.level for r in order.topo_levels(spark.createDataFrame(pairs, "f string, t string")).collect()}
    assert "x" not in level and all(level[a] > level[b] for a, b in pairs if a not in "xy")


def test_cycles_both_ways(spark):
    deps = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "f string, t string")
    found = health.cycles(deps)
    assert sorted((r.start, r.next, r.length) for r in found.collect()) == [("a", "b", 2), ("b", "a", 2)]
    assert health.distinct_cycles(found).count() == 1


def test_documents_round_trip(spark, risky, tmp_path):
    path = str(tmp_path / "g.json")
    graphfile.save(risky, path)
    g = graphfile.load_many(spark, [path])
    assert sorted(r.id for r in g.nodes.collect()) == sorted(r.id for r in risky.nodes.collect())
    assert g.edges.select("src", "dst", "kind").exceptAll(risky.edges.select("src", "dst", "kind")).count() == 0
    both = graphfile.load_many(spark, [path, path])
    assert both.nodes.count() == 12 and both.nodes.select("id").distinct().count() == 12
    graphfile.save_tables(risky, str(tmp_path / "t"))
    assert graphfile.load_tables(spark, str(tmp_path / "t")).edges.count() == 5
    with pytest.raises(FileNotFoundError):
        graphfile.load(spark, str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text('{"schema_version": 2, "nodes": [{"id": "x"}], "edges": [], "warnings": []}')
    with pytest.raises(ValueError, match="kind"):
        graphfile.load(spark, str(tmp_path / "bad.json"))
    assert sets.diff(risky, g).count() == 0


def test_texts(risky):
    assert "target_fn" in render.repo_map(risky)
    assert len(render.repo_map(risky, 60).encode()) <= 60
    assert "health" in render.report(risky)
    assert render.within("é" * 50, 40).startswith("é")
    assert '"visibility": "pub"' in render.to_json("nodes", risky.nodes.limit(1))


def test_evidence(spark, risky):
    lines = ["fn target_fn() -> () {", "  _1 = dep1(move _2) -> [return: bb1];", "  _3 = std::mem::drop(_1) -> bb2;", "fn caller_a() {", "  _1 = target_fn() -> bb1;", "  _2 = unknown_fn() -> bb3;"]
    e = evidence.mir_edges(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"), risky.nodes)
    assert sorted((r.src, r.dst) for r in e.collect()) == [("function:caller_a", "function:target_fn"), ("function:target_fn", "function:dep1")]
    s = evidence.flatten_symbols([{"name": "dep1", "kind": 12, "range": {"start": {"line": 0}}, "children": [{"name": "x", "kind": 99, "range": {"start": {"line": 3}}}]}], "src/dep.rs")
    assert s == [("src/dep.rs", "dep1", "function", 1), ("src/dep.rs", "x", "unknown", 4)]
    c = evidence.confirm_symbols(risky.nodes, spark.createDataFrame(s, "file string, name string, kind string, line long"))
    assert [r.name for r in c.where("confirmed").collect()] == ["dep1"]
    rows = gitlog.parse(spark.createDataFrame([(0, "ann\n\na.rs\nb.rs\n\n"), (1, "bob\n\na.rs\n"), (2, "eve\n")], "commit long, value string")).collect()
    assert [(r.author, r.file) for r in rows] == [("ann", "a.rs"), ("ann", "b.rs"), ("bob", "a.rs")]


def test_upsert_keeps_first_and_confirms(spark):
    e = spark.createDataFrame([(1, "a", "b", "calls", 1, "x", None, "direct", "ast", "definite", ["p"]), (2, "a", "b", "calls", 2, "y", None, "method", "mir", "confirmed", ["q"]), (3, "a", "a", "calls", 1, "z", None, None, "ast", "definite", [])], "ord long, src string, dst string, kind string, weight long, label string, evidence struct<file:string,line:long>, call_style string, source string, certainty string, profiles array<string>")
    r = link.upsert(e).collect()
    assert [(x.weight, x.label, x.call_style, x.source, x.certainty, x.profiles) for x in r] == [(3, "x", "direct", "mir", "confirmed", ["p", "q"])]


def test_refresh(spark, tmp_path):
    landing, folder, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    table = refresh.EdgeTable(spark, folder)

    def land(rows):
        spark.createDataFrame([(f, n, a, b, "calls", 1, "ast", "definite") for f, n, a, b in rows], refresh.LANDED).coalesce(1).write.mode("append").parquet(landing)
        refresh.refresh(spark, landing, table, state).awaitTermination()
        return sorted((r.file, r.src, r.dst) for r in table.edges().collect())

    assert land([("a.rs", 1, "x", "y"), ("b.rs", 1, "y", "z")]) == [("a.rs", "x", "y"), ("b.rs", "y", "z")]
    assert land([("a.rs", 2, "x", "w")]) == [("a.rs", "x", "w"), ("b.rs", "y", "z")]
    assert land([("b.rs", 2, None, None)]) == [("a.rs", "x", "w")]
    assert land([("b.rs", 1, "y", "z")]) == [("a.rs", "x", "w")], "an older version that comes late changes nothing"


def test_event_windows(spark, tmp_path):
    d = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(d).schema
    stream = spark.readStream.schema(schema).parquet(d.replace("events.parquet", "event*"))
    q = refresh.event_counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").count() > 0
