"""Graph operators: known cases, and the three passes against a walk over random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import clean, closure, dirty, history, planning, tools
from weftgraph.plans import queries
from weftgraph.plans.graph import BuildGraph
from weftgraph.plans.simulate import Build, hashed
from weftgraph.functions.hashing import rapid64
from weftgraph.sources import logs
from weftgraph.sources.files import literal
from weftgraph.sources.manifest import Manifest

RULES = (
    "rule cat\n  command = cat $in > $out\nrule res\n  command = res $in > $out\n  restat = 1\nrule gen\n  command = gen $in > $out\n  generator = 1\n"
    "rule dep\n  command = dep $in > $out\n  deps = gcc\n  depfile = $out.d\n"
)


def random_tree(rng, name):
    """Text of a small graph, files, build log and deps log; paths begin with `name`."""
    n = rng.randint(3, 9)
    text, made, files, log, deps = "", [], {}, {}, {}
    leaves = [f"{name}/l{k}" for k in range(4)]
    for leaf in leaves:
        if rng.random() < 0.9:
            files[leaf] = rng.randint(1, 8)
    for k in range(n):
        rule = rng.choice(["cat", "cat", "res", "gen", "dep", "phony", "phony"])
        pool = leaves + made
        ins = rng.sample(pool, min(len(pool), rng.randint(0 if rule == "phony" else 1, 3)))
        only = rng.sample(pool, rng.randint(0, 2)) if rng.random() < 0.3 else []
        outs = [f"{name}/o{k}"] + ([f"{name}/p{k}"] if rng.random() < 0.25 else [])
        text += f"build {' '.join(outs)}: {rule} {' '.join(ins)}" + (f" || {' '.join(only)}" if only else "") + "\n"
        for o in outs:
            if rng.random() < (0.2 if rule == "phony" else 0.85):
                files[o] = rng.randint(1, 8)
            if rng.random() < 0.8 and rule != "phony":
                log[o] = (0, 1, rng.randint(1, 8), rng.random() < 0.85)
        if rule == "dep" and rng.random() < 0.8:
            deps[outs[0]] = (rng.randint(1, 9), rng.sample(pool, min(2, len(pool))))
        made += outs
    return text, files, log, deps


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(5)
    text, files, log, deps = RULES, {}, {}, {}
    for k in range(250):
        t, f, g, d = random_tree(rng, f"t{k}")
        text += t
        files |= f
        log |= g
        deps |= d
    m = Manifest().parse("build.ninja", text)
    own = {o: f"{rapid64(hashed(s).encode()):x}" for s in m.statements for o, _ in s.outputs}
    log = {o: (a, b, c, own[o] if same else "0") for o, (a, b, c, same) in log.items()}
    build = Build(m, dict(files), build_log=log, deps_log=deps)
    build.scan()
    rows = m.rows()
    g = BuildGraph.from_manifest(
        spark, m, files=literal(spark, files),
        build_log=spark.createDataFrame([(k, o, a, b, c, h) for k, (o, (a, b, c, h)) in enumerate(log.items())], logs.BUILD_LOG),
        deps_log=spark.createDataFrame([(k, o, t, p, x) for k, (o, (t, ins)) in enumerate(deps.items()) for p, x in enumerate(ins)], logs.DEPS_LOG),
    )
    hashes = spark.createDataFrame([(r[0], own[m.statements[r[0]].outputs[0][0]]) for r in rows["edges"]], "edge_id long, command_hash string")
    g = g.with_(edges=g.edges.join(hashes, "edge_id"))
    return m, build, g, dirty.scan(g)


def test_three_passes_equal_the_walk(forest):
    m, build, _, scan = forest
    got = {r.edge_id: (r.dirty, r.ready, r.deps_missing) for r in scan.edges.collect()}
    want = {s.number: (build.dirty[s.number], build.ready[s.number], s.number in build.deps_missing) for s in m.statements}
    assert 0.2 < sum(d for d, _, _ in want.values()) / len(want) < 0.95
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_explanations_equal_the_walk(forest):
    m, build, _, scan = forest
    got = {}
    for r in dirty.explanations(scan).collect():
        got.setdefault(r.edge_id, set()).add(r.reason)
    want = {k: set(v) for k, v in build.reasons.items()}
    # The statement's own reason is only looked for while nothing else has made it dirty.
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}


def test_plan_and_order_equal_the_walk(spark, forest):
    m, build, g, scan = forest
    targets = [s.outputs[0][0] for s in m.statements if s.number % 7 == 0]
    missing = {p for s in m.statements for p, _ in s.inputs if p not in build.producer and p not in build.files}
    targets = [t for t in targets if not missing & set(t.split())]
    t = spark.createDataFrame([(x,) for x in targets], "path string")
    plan = planning.wanted(scan, t)
    got = {r.edge_id: r.want for r in plan.collect()}
    want, todo = {}, list(targets)
    while todo:
        s = build.producer.get(todo.pop())
        if s is not None and s.number not in want and not build.ready[s.number]:
            want[s.number] = "to_start" if build.dirty[s.number] else "nothing"
            todo += [p for p, _ in build.inputs(s)]
    assert got == want
    build.want = {k: v == "to_start" for k, v in want.items()}
    weights = {r.edge_id: r.weight for r in planning.critical_paths(plan, g.edges, scan.graph.links()).collect()}
    assert weights == build.critical_paths()
    ready = {r.edge_id for r in planning.ready_edges(plan, scan.graph.links()).collect()}
    open_ = {s.number for s in m.statements if any((p := build.producer.get(x)) is not None and p.number in want for x, _ in build.inputs(s))}
    assert ready == {k for k, v in want.items() if v == "to_start"} - open_


SMALL = "rule cat\n  command = cat $in > $out\n  description = CAT $out\nbuild b: cat a\nbuild c: cat b\nbuild all: phony c\nbuild multi m2: cat c | b || a\n  pool = console\n"


@pytest.fixture(scope="module")
def small(spark):
    return BuildGraph.from_text(spark, SMALL, files=literal(spark, {"a": 1, "b": 2, "old": 3}))


def targets(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "path string")


def test_lists(spark, small):
    assert [tuple(r) for r in tools.source_inputs(small).orderBy("edge_id").select("path").collect()] == [("a",), ("a",)]
    assert sorted(map(tuple, tools.rules(small).collect()), key=str) == [("cat", "CAT ${out}"), ("phony", None)]
    assert {r.path for r in small.default_nodes().collect()} == {"all", "multi", "m2"}
    assert {r.path for r in tools.inputs(small, targets(spark, "all")).collect()} == {"a", "b", "c"}
    assert [r.command for r in tools.commands(small, targets(spark, "all")).orderBy("level", "edge_id").collect()] == ["cat a > b", "cat b > c"]
    assert {(r.edge_id, r.text) for r in tools.format_edge(small).collect()} >= {(0, "[ a --cat-> b ]"), (3, "[ c b a --cat-> multi m2 ]")}
    assert [r.json for r in tools.compdb_json(tools.compdb(small, ["cat"], "/x").where("edge_id = 0")).collect()] == ['{"directory":"/x","command":"cat a > b","file":"a","output":"b"}']
    depth = tools.targets_by_depth(small, targets(spark, "all"), 0).orderBy("place").collect()
    assert [(r.level, r.path, r.rule) for r in depth] == [(0, "all", "phony"), (1, "c", "cat"), (2, "b", "cat"), (3, "a", "")]
    q = {(r.section, r.item) for r in tools.query(small, targets(spark, "multi", "c")).collect()}
    assert {("input", "| b"), ("input", "|| a"), ("output", "all"), ("output", "m2"), ("rule", "cat")} <= q
    text = [r.line for r in tools.graph_text(spark, tools.graph_rows(small, targets(spark, "all"))).collect()]
    assert text[0] == "digraph ninja {"
    assert text[-1] == "}"
    assert '"n1" -> "n0" [label=" cat"]' in text


def test_names(spark, small):
    assert [r.path for r in tools.resolve(small, ["./c", "b^"]).orderBy("seq").collect()] == ["c", "c"]
    with pytest.raises(tools.TargetError, match="unknown target 'mult', did you mean 'multi'"):
        tools.resolve(small, ["mult"])
    with pytest.raises(tools.TargetError, match="'all' has no out edge"):
        tools.resolve(small, ["all^"])
    with pytest.raises(tools.TargetError, match="empty path"):
        tools.resolve(small, [""])


def test_scopes(spark):
    g = BuildGraph.from_text(spark, "a = 1\nb = 2\nsubninja s\n", {"s": "a = 3\n"}.get)
    assert sorted(map(tuple, tools.scope_values(g).collect())) == [(0, "a", "1"), (0, "b", "2"), (1, "a", "3"), (1, "b", "2")]


def test_clean(spark, small):
    assert {r.path for r in clean.clean_all(small).collect()} == {"b", "c", "multi", "m2"}
    assert {r.path for r in clean.clean_targets(small, targets(spark, "multi")).collect()} == {"multi", "b", "c"}
    names = spark.createDataFrame([("cat",), ("no",)], "name string")
    assert {r.path for r in clean.removable(clean.clean_rules(small, names), small.files).collect()} == {"b"}
    assert [r.message for r in clean.unknown_rules(small, names).collect()] == ["unknown rule 'no'"]
    log = spark.createDataFrame([(0, "old", 0, 1, 1, "0"), (1, "a", 0, 1, 1, "0"), (2, "b", 0, 1, 1, "0")], logs.BUILD_LOG)
    assert [r.path for r in clean.dead_outputs(small, log).collect()] == ["old"]
    running = spark.createDataFrame([(0, "b", 1)], "edge_id long, path string, before long")
    assert [r.path for r in clean.leftovers(small, running).collect()] == ["b"]


def test_logs(spark, small):
    log = spark.createDataFrame([(0, "old", 0, 1, 1, "0"), (1, "gone", 0, 1, 1, "0"), (2, "c", 5, 9, 1, "0"), (3, "c", 5, 8, 1, "0")], logs.BUILD_LOG)
    assert {r.line_no for r in history.compact_build_log(small, log).collect()} == {0, 3}
    assert {r.edge_id: r.elapsed_ms for r in history.previous_elapsed(small, log).collect()} == {0: -1, 1: 3, 2: -1, 3: -1}
    assert {(r.output, r.mtime) for r in logs.restat(log, small.files, ["old", "c"]).collect()} == {("old", 3), ("gone", 1), ("c", 0)}


def test_missing_deps(spark):
    text = "rule g\n  command = g > $out\nrule cc\n  command = cc $in\n  deps = gcc\n  depfile = x\nbuild gen.h: g\nbuild out: cc in.c\nbuild fine: cc in.c | gen.h\n"
    log = spark.createDataFrame([(0, "out", 1, 0, "gen.h"), (1, "fine", 1, 0, "gen.h")], logs.DEPS_LOG)
    g = BuildGraph.from_text(spark, text, deps_log=log, files=literal(spark, {}))
    t = targets(spark, "out", "fine")
    found = tools.missing_deps(g, t).cache()
    assert [r.line for r in tools.missing_deps_lines(found).collect()] == ["Missing dep: out uses gen.h (generated by g)"]
    report = tools.missing_deps_report(g, t, found)
    assert tuple(report.first()) == (3, 1, 1, 1, 1)
    assert "Error: There are 1 missing dependency paths.\n1 targets had" in tools.missing_deps_summary(report).first().text
    g = g.with_(deps_log=log.unionByName(spark.createDataFrame([(0, "out", 1, 1, "build.ninja")], logs.DEPS_LOG)))
    assert tools.missing_deps(g, t).count() == 0
    assert {(r.output, r.n_deps, r.state) for r in tools.deps(g, t).collect()} == {("out", 2, "STALE"), ("fine", 1, "STALE")}


def test_closure_tools(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (7, 8), (8, 9), (9, 7), (9, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 10)], "node long")
    seeds = spark.createDataFrame([(1, "x"), (3, "y")], "node long, k string")
    assert {(r.k, r.node) for r in closure.closure(seeds, links, ["k"]).collect()} == {("x", 1), ("x", 2), ("x", 3), ("x", 4), ("y", 3), ("y", 4)}
    rest = closure.cyclic(nodes, links)
    assert {r.node for r in rest.collect()} == {5, 7, 8, 9}
    path = closure.cycle_path([(r.src, r.dst) for r in links.collect()])
    assert path[0] == path[-1]
    assert set(path) == {7, 8, 9}
    acyclic = links.where("src < dst and src < 5")
    assert {r.node: r.level for r in closure.levels(nodes, acyclic).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0}
    chain = spark.createDataFrame([(k, k - 1 if k % 50 else None) for k in range(100)], "node long, parent long")
    assert all(r.depth == r.node % 50 and r.root == r.node - r.node % 50 for r in closure.chain_roots(chain).collect())
    empty = closure.closure(seeds.limit(0), links, ["k"])
    assert empty.count() == 0


def test_pools(spark):
    ready = spark.createDataFrame([(1, "p", 5), (2, "p", 7), (3, "p", 7), (4, "", 1)], "edge_id long, pool string, weight long")
    pools = spark.createDataFrame([("", 0), ("p", 2)], "name string, depth int")
    assert {r.edge_id for r in planning.admitted(ready, pools).where("admitted").collect()} == {2, 3, 4}
    used = spark.createDataFrame([("p", 1)], "pool string, use int")
    assert {r.edge_id for r in planning.admitted(ready, pools, used).where("admitted").collect()} == {2, 4}
    assert [r.edge_id for r in planning.next_batch(ready, 2).collect()] == [2, 3]


def test_dyndeps(spark):
    g = BuildGraph.from_text(spark, "rule c\n  command = c\nbuild a: c x || dd\n  dyndep = dd\n")
    new = spark.createDataFrame([(0, True, ["a2"], ["h"])], "edge_id long, restat boolean, implicit_outputs array<string>, implicit_inputs array<string>")
    h = g.with_dyndeps(new)
    assert [(r.path, r.kind) for r in h.edge_inputs.orderBy("pos").collect()] == [("x", "explicit"), ("h", "implicit"), ("dd", "order_only")]
    assert {r.path for r in h.edge_outputs.collect()} == {"a", "a2"}
    assert h.edges.first().restat
    loaded = spark.createDataFrame([("dd", 9)], "dyndep string, edge_id long")
    assert any("not mentioned" in r.message for r in g.dyndep_errors(new, loaded).collect())


def test_progress(spark):
    done = spark.createDataFrame([(1, 100, 50, 40), (2, 300, 60, -1)], "seq long, time_ms long, duration_ms long, elapsed_ms long")
    totals = spark.createDataFrame([(4, 2, 2, 90)], "total long, predictable long, unpredictable long, predictable_ms long")
    rows = history.progress(done, totals).orderBy("seq").collect()
    assert rows[0].share == pytest.approx(50 / (50 + 2 * 50 + 50))
    rates = history.current_rates(done, 2).orderBy("seq").collect()
    assert [r.rate for r in rates] == [-1.0, 5.0]
    results = spark.createDataFrame([(1, 0, 5), (2, 3, 5), (3, 4, 5), (4, 0, 5)], "seq long, code int, duration_ms long")
    assert tuple(history.build_summary(results).first()) == (4, 2, 20, 4)


def test_deep_chains(spark):
    """Chains of 2,000 and of 60,000 statements."""
    for n in (2_000, 60_000):
        nodes = spark.range(n).select(F.col("id").alias("node"), F.lit(1).alias("weight"))
        links = nodes.where(f"node < {n - 1}").select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
        assert closure.closure(nodes.where("node = 0").select("node"), links).count() == n
        cost = closure.longest_paths(nodes, links)
        assert cost.where(f"cost = {n} - node").count() == n
        assert closure.cyclic(nodes, links).count() == 0
    with pytest.raises(Exception, match="a circle"):
        closure.longest_paths(nodes, links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


def test_deep_tree_is_judged(spark):
    n = 2_000
    text = "rule r\n  command = r $in $out\n" + "".join(f"build f{k + 1}: r f{k}\n" for k in range(n))
    g = BuildGraph.from_text(spark, text, files=spark.createDataFrame([("f0", 5)] + [(f"f{k + 1}", 7 + k) for k in range(n)], "path string, mtime long"))
    assert dirty.scan(g).edges.where("dirty").count() == 0
    g = g.with_(files=g.files.where("path <> 'f3'"))
    s = dirty.scan(g)
    assert s.edges.where("dirty").count() == n - 2
    assert planning.wanted(s, spark.createDataFrame([(f"f{n}",)], "path string")).count() == n - 2


def test_rounds_and_one_task_agree(spark, monkeypatch):
    rng = random.Random(77)
    for k in range(2):
        pairs = [(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(45)) if a < b or (k and rng.random() < 0.1)]
        links = spark.createDataFrame(pairs, "src long, dst long")
        nodes = spark.range(30).select(F.col("id").alias("node"), (F.col("id") % 3).alias("weight"))
        seeds = nodes.where("node < 3").select("node")

        def results(links=links, nodes=nodes, seeds=seeds, k=k):
            out = [closure.closure(seeds, links), closure.cyclic(nodes, links)]
            out += [] if k else [closure.longest_paths(nodes, links)]
            return [sorted(map(tuple, x.collect())) for x in out]

        monkeypatch.setattr(closure, "ONE_TASK", 1_000_000)
        want = results()
        monkeypatch.setattr(closure, "ONE_TASK", -1)
        monkeypatch.setattr(closure, "MERGE_EVERY", 2)
        assert results() == want


def test_dump_of_a_plan(spark):
    g = BuildGraph.from_text(spark, "rule cc\n  command = cc\nbuild a.o: cc a.c | h\nbuild all: phony a.o\n")
    edges = {r.rule: r.edge_id for r in g.edges.collect()}
    plan = spark.createDataFrame([(edges["cc"], "to_start"), (edges["phony"], "nothing")], "edge_id long, want string")
    got = planning.dump(g, plan, plan.where("want = 'to_start'")).orderBy("part", "edge_id").collect()
    assert [r.line for r in got] == ["pending: 2", "want [ a.c h --cc-> a.o ]", "[ a.o --phony-> all ]", "ready: 1"]


def _statically_broadcast(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def _watch(monkeypatch, module):
    """What `module` writes from now on that the planner, by the size of files, would join by a broadcast; explicit ones are switched off."""
    found = []

    def watch(name):
        own = getattr(module, name)

        def seen(df, label, *more):
            found.extend([label] * _statically_broadcast(df))
            return own(df, label, *more)

        monkeypatch.setattr(module, name, seen)

    watch("stage")
    watch("stage_counted")
    monkeypatch.setattr(closure, "SMALL", -1)
    monkeypatch.setattr(closure, "ONE_TASK", -1)
    return found


def test_walks_broadcast_nothing_uncounted(spark, monkeypatch):
    found = _watch(monkeypatch, closure)
    links = spark.createDataFrame([(k, k + 1) for k in range(4)], "src long, dst long")
    links, nodes = closure.stage(links, "t"), closure.stage(spark.createDataFrame([(k, k + 1) for k in range(5)], "node long, weight long"), "t")
    assert {tuple(r) for r in closure.longest_paths(nodes, links).collect()} == {(0, 15), (1, 14), (2, 12), (3, 9), (4, 5)}
    assert {tuple(r) for r in closure.levels(nodes.select("node"), links).collect()} == {(k, k) for k in range(5)}
    assert {r.node for r in closure.closure(nodes.where("node = 2").select("node"), links).collect()} == {2, 3, 4}
    assert closure.cyclic(nodes.select("node"), links).count() == 0
    assert found == []


def test_plans_broadcast_nothing_uncounted(spark, monkeypatch):
    walks, scans = _watch(monkeypatch, closure), _watch(monkeypatch, dirty)
    text = RULES + "build a: cat x\nbuild b: dep a\nbuild all: phony b\n"
    g = BuildGraph.from_text(spark, text, files=literal(spark, {"x": 1}), build_log=BuildGraph.empty_log(spark), deps_log=BuildGraph.empty_deps(spark))
    s = dirty.scan(g.with_(edges=g.edges.withColumn("command_hash", F.lit("h"))))
    plan = closure.stage(planning.wanted(s, spark.createDataFrame([("all",)], "path string")), "t")
    assert {r.want for r in plan.collect()} == {"to_start"} and plan.count() == 3
    links = s.graph.links()
    elapsed = history.previous_elapsed(s.graph)
    results = [
        s.nodes, links, elapsed, dirty.explanations(s), planning.missing_leaves(s, plan, s.graph.edge_inputs), planning.counters(s, plan), planning.ready_edges(plan, links),
        planning.all_inputs_ready(s.graph.edge_inputs, s.graph.edge_outputs, plan), history.plan_totals(plan, s.graph.edges, elapsed),
    ]
    assert [k for k, df in enumerate(results) if _statically_broadcast(df)] == []
    assert planning.critical_paths(plan, s.graph.edges, links).agg(F.max("weight")).first()[0] == 2
    assert walks == scans == []


def test_pool_admission_broadcasts_no_statements(spark, monkeypatch):
    """Only the pools, a row each, are a broadcast side; statements are not, however small their files are."""
    text = "pool p\n  depth = 1\nrule cat\n  command = cat $in > $out\n  pool = p\nbuild a: cat x\nbuild b: cat x\nbuild c: cat x\n  pool =\nbuild d: cat c\nbuild all: phony a b d\n"
    g = BuildGraph.from_text(spark, text, files=literal(spark, {"x": 1}))
    s = dirty.scan(g)
    plan = closure.stage(planning.wanted(s, targets(spark, "all")), "t")
    monkeypatch.setattr(queries, "_plan", lambda *_: (s, plan))
    got = queries.QUERIES["pool_admission"](spark, "")
    joins = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]
    assert joins and all("[pool#" in x for x in joins)
    assert {(r.edge_id, r.pool, r.weight, r.admitted) for r in got.collect()} == {(0, "p", 1, True), (1, "p", 1, False), (2, "", 1, True)}
