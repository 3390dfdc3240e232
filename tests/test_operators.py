import json
import random

import pytest
from pyspark.sql import functions as F

from flowlens.functions import text as T
from flowlens.operators import cfg, edges, loops, paths, pointsto, reports, runs, trees
from flowlens.sources import facts, sinks
from flowlens.streaming import runs as streamed


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


# edges


def test_coverage(spark):
    static = frame(spark, "caller string, callee string", ("m", "a"), ("m", "b"), ("a", "c"), ("a", "c"))
    runtime = frame(spark, "caller string, callee string", ("m", "a"), ("x", "y"))
    assert got(edges.uncovered(static, runtime)) == [("a", "c"), ("m", "b")]
    assert got(edges.covered(static, runtime)) == [("m", "a")]
    assert tuple(edges.coverage_summary(static, runtime).first()) == (3, 2, 2, 4, 4, 33.333333)
    assert edges.coverage_summary(static.limit(0), runtime).first()["coverage_percent"] == 0.0


def test_roots_fall_back_to_the_first_name(spark):
    assert got(edges.roots(frame(spark, "caller string, callee string", ("a", "b"), ("c", "b")))) == [("a",), ("c",)]
    assert got(edges.roots(frame(spark, "caller string, callee string", ("b", "a"), ("a", "b")))) == [("a",)]


def test_argument_profiles(spark):
    sites = frame(spark, "site long, callee string, n_args int", (1, "f1", 1), (1, "f2", 1), (2, "f1", 0), (2, "f2", 0), (3, "other", 0))
    targets = frame(spark, "callee string, n_params int", ("f1", 1), ("f2", 0))
    assert got(edges.fitting_targets(sites, targets)) == [(1, "f1"), (1, "f2"), (2, "f2"), (3, "other")]


def test_static_callers_use_the_fallback_only_for_unknown_tokens(spark):
    static = frame(spark, "caller string, callee string", ("m", "t"), ("d", "<indirect-call>"))
    candidates = frame(spark, "token string, caller string", ("t", "m"), ("t", "d"), ("u", "d"), ("u", "m"))
    assert got(edges.static_callers(candidates, static)) == [("t", "m"), ("u", "d")]


def test_mapping_misses_become_unknown(spark):
    sites = frame(spark, "site long, sig string", (1, "a"), (2, "b"), (3, None))
    assert got(edges.resolve_by_mapping(sites, frame(spark, "sig string, target string", ("a", "f"), ("a", "g")), ["sig"])) == [
        (1, "f", "indirect"), (1, "g", "indirect"), (2, edges.UNKNOWN, "indirect-unknown"), (3, edges.UNKNOWN, "indirect-unknown")]


# fixpoints


@pytest.mark.parametrize(
    "addr, copy, load, store, seed, xfer, want",
    [
        ([("x", "f")], [("x", "y")], [], [], [], [], {("x", "f"), ("y", "f")}),
        ([("p", "o"), ("s", "g")], [], [("p", "d")], [("p", "s")], [], [], {("p", "o"), ("s", "g"), ("o", "g"), ("d", "g")}),
        ([("p", "o")], [], [("p", "d")], [], [("p", "h")], [], {("p", "o"), ("o", "h"), ("d", "h")}),
        ([("sp", "so"), ("dp", "do"), ("so", "k")], [], [], [], [], [("sp", "dp")], {("sp", "so"), ("dp", "do"), ("so", "k"), ("do", "k")}),
        ([("a", "f")], [("a", "b"), ("b", "a")], [], [], [], [], {("a", "f"), ("b", "f")}),
    ],
)
def test_points_to(spark, addr, copy, load, store, seed, xfer, want):
    made = frame(spark, "node string, obj string", *addr), frame(spark, "src string, dst string", *copy), frame(spark, "ptr string, dst string", *load), frame(spark, "ptr string, src string", *store)
    found = pointsto.points_to(*made, frame(spark, "ptr string, obj string", *seed), frame(spark, "sp string, dp string", *xfer))
    assert set(got(found)) == want


def test_points_to_with_cycles_as_one_node(spark):
    r = random.Random(3)
    node = [f"n{i}" for i in range(12)]
    some = lambda n: [(r.choice(node), r.choice(node)) for _ in range(n)]
    made = frame(spark, "node string, obj string", *some(6)), frame(spark, "src string, dst string", *some(14), ("n0", "n1"), ("n1", "n0")), frame(spark, "ptr string, dst string", *some(3)), frame(spark, "ptr string, src string", *some(3))
    more = frame(spark, "ptr string, obj string", *some(2)), frame(spark, "sp string, dp string", *some(2))
    assert got(pointsto.points_to(*made, *more, collapse=True)) == got(pointsto.points_to(*made, *more))


def test_large_rounds_are_joined_by_a_shuffle(spark):
    edge = frame(spark, "src long, dst long", *[(i, (i * 7 + 3) % 50) for i in range(50)])
    known, rows = edge.limit(20), edge.unionByName(edge)
    assert got(loops.unseen(rows, known, ["src", "dst"], small=1)) == got(loops.unseen(rows, known, ["src", "dst"])) == got(edge.subtract(known))


def test_strong_components_and_reachability(spark):
    edge = frame(spark, "src string, dst string", ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e"))
    for small in (0, 100):
        assert got(loops.strong_components(edge, small=small)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e")]
    assert got(loops.reachable(edge, frame(spark, "seed string", ("c",)))) == [("c", "c"), ("c", "d")]


def walked(edges):
    """The edges that a depth-first walk from the least nodes, children by name, doesn't find to lead back."""
    state, back = {}, set()

    def visit(n):
        state[n] = 1
        for m in sorted(b for a, b in edges if a == n):
            if state.get(m) == 1:
                back.add((n, m))
            elif m not in state:
                visit(m)
        state[n] = 2

    for n in sorted({a for a, _ in edges}):
        if n not in state:
            visit(n)
    return set(edges) - back


def test_edges_that_lead_back_go(spark):
    nested = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "c"), ("d", "e"), ("e", "a"), ("e", "e"), ("e", "f"), ("a", "b"), ("f", "g"), ("g", "f")]
    r = random.Random(4)
    tangled = [(f"n{r.randrange(12):02}", f"n{r.randrange(12):02}") for _ in range(40)]
    edge = frame(spark, "src string, dst string", *nested, *tangled)
    small = {tuple(e) for e in got(loops.without_back_edges(edge))}
    assert small == {tuple(e) for e in got(loops.without_back_edges(edge, small=3))}
    assert {e for e in small if e[0][0] != "n"} == walked(nested)
    assert {e for e in small if e[0][0] == "n"} <= set(tangled) and walked(sorted(small)) == small  # no cycle is left
    assert loops.without_back_edges(edge.limit(0)).collect() == []


def test_pointers_all_of_whose_definitions_lead_to_one_global(spark):
    rows = [
        ("f", "p", "&g.x"), ("f", "q", "p + 1"), ("f", "r", "(q)"), ("f", "r", "g"), ("f", "s", "r"), ("f", "s", "h"), ("f", "t", "s"), ("f", "u", "local"), ("f", "u", "g"), ("f", "a", "b"), ("f", "b", "a"), ("f", "c", "a"),
        ("f", "c", "g"), ("f", "d", "d"), ("f", "d", "g"), ("f", "e", None), ("f", "m.x", "z"), ("f", "n", "m->y"), ("f", "o", "n"), ("f", None, "g"), ("k", "q", "p"),
    ]
    names, marked = frame(spark, "name string", ("g",), ("h",)), frame(spark, "fn string, name string", ("f", "m"), ("f", "q"))
    definitions = frame(spark, "fn string, pointer string, rhs string", *rows)
    plain = [("f", "p", "g"), ("f", "q", "g"), ("f", "r", "g")]
    assert got(cfg.global_pointers(definitions, names)) == plain
    assert got(cfg.global_pointers(definitions, names, marked)) == sorted([*plain, ("f", "m", "m"), ("f", "n", "m"), ("f", "o", "m")])


def test_bounded_contexts_of_a_chain(spark):
    edge = frame(spark, "caller string, callee string", ("main", "pd_init"), ("pd_init", "pe_exit"), ("pd_init", "sys_config"), ("pe_exit", "sparse"))
    node, link = loops.bounded_contexts(edge, frame(spark, "node string", ("main",)), 2)
    assert got(node) == [("main", ""), ("pd_init", "main"), ("pe_exit", "main>pd_init"), ("sparse", "pd_init>pe_exit"), ("sys_config", "main>pd_init")]
    assert link.count() == 4
    loop = frame(spark, "caller string, callee string", ("a", "a"))
    assert loops.bounded_contexts(loop, frame(spark, "node string", ("a",)), 2)[0].count() == 3
    with pytest.raises(ValueError):
        loops.bounded_contexts(edge, frame(spark, "node string", ("main",)), 0)


def test_rounds_are_bounded(spark):
    with pytest.raises(RuntimeError):
        loops.grow(frame(spark, "n long", (0,)), lambda new: new.select((F.col("n") + 1).alias("n")), max_rounds=3)


# control flow


def test_calls_to_the_exit_and_passthrough(spark):
    block = frame(spark, "fn string, block long, succ long", ("f", 1, 2), ("f", 2, 3), ("f", 2, 4), ("f", 3, 5), ("f", 4, 5), ("f", 5, None), ("f", 9, 9))
    calls, exits = frame(spark, "fn string, block long, n int", ("f", 1, 1), ("f", 3, 2), ("f", 4, 1)), frame(spark, "fn string, block long", ("f", 5))
    assert got(cfg.min_calls_to_exit(block, calls, exits)) == [("f", 1, 2), ("f", 2, 1), ("f", 3, 2), ("f", 4, 1), ("f", 5, 0), ("f", 9, None)]
    chain = frame(spark, "fn string, block long, succ long", *[("f", i, i + 1) for i in range(1, 12)], ("f", 12, None))
    assert got(cfg.collapse_passthrough(chain, chain.where("block between 2 and 11").select("fn", "block").distinct())) == [("f", 1, 12), ("f", 12, None)]
    assert got(cfg.linear_functions(block.unionByName(frame(spark, "fn string, block long, succ long", ("g", 1, 2), ("g", 2, None))))) == [("f", False), ("g", True)]


# context runs


def log(spark, text, names):
    lines = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(text.split())], "trace long, line_number long, value string")
    return facts.log_events(lines, spark.createDataFrame([(n,) for n in names], "name string"))


def test_nested_runs(spark):
    events = log(spark, "main_entry loglog Timer_ISR_entry process_data Timer_ISR_exit abcd main_exit", ["main", "Timer_ISR"])
    run = runs.context_runs(events)
    assert got(run.select("context_id", "parent_start", "end", "owned", "forced")) == [("Timer_ISR#1@2", 0, 4, 3, False), ("main#1@0", None, 6, 4, False)]
    owned = runs.owners(events)
    assert got(runs.segments(owned).select("run_start", "start", "end")) == [(0, 0, 1), (0, 5, 6), (2, 2, 4)]
    assert got(runs.interrupts(owned, run).select("run_start", "event_index", "kind", "related")) == [(0, 2, "interrupt_start", 2), (0, 5, "interrupt_end", 2)]
    assert runs.child_calls(run, frame(spark, "caller string, callee string", ("x", "main"))).count() == 0
    for callee in ("Timer_ISR", "<indirect-call>"):
        assert got(runs.child_calls(run, frame(spark, "caller string, callee string", ("x", callee)))) == [(1, 0, 2, "Timer_ISR")]


def test_forced_closes_and_exits_without_a_run(spark):
    names = ["a", "b", "c"]
    assert got(runs.context_runs(log(spark, "a_entry b_entry a_exit", names)).select("entrypoint", "forced")) == [("a", False), ("b", True)]
    events = log(spark, "a_entry b_entry c_exit x_entry", names)
    assert got(runs.context_runs(events).select("entrypoint", "end", "forced")) == [("a", 2, True), ("b", 2, True)]
    assert got(runs.owners(events).select("event_index", "run_start"))[2:] == [(2, None), (3, None)]
    assert got(events.select("kind", "base_name"))[-1] == ("Plain", "x_entry")


def test_candidates_are_ranked(spark):
    ranked = trees.rank_callers(frame(spark, "trace long, event_index long, caller string, depth int", (1, 5, "far", 2), (1, 5, "near", 1), (1, 6, "only", 3)))
    assert got(ranked.select("caller", "rank", "delta")) == [("far", 1, 0.25), ("near", 0, 0.0), ("only", 0, 0.0)]
    assert got(trees.best_total(ranked)) == [(1, 0.0, 2, 1)]


# trees


def test_trees(spark):
    calls = frame(spark, "context_id long, event_index long, caller string, callee string", (1, 1, "m", "a"), (1, 2, "a", "b"), (1, 3, "m", "a"), (1, 4, "zz", "c"), (2, 1, "m", "a"))
    path = trees.call_paths(calls)
    assert got(path.select("context_id", "path")) == [(1, "m/a"), (1, "m/a"), (1, "m/a/b"), (1, "m/c"), (2, "m/a")]
    tree = trees.merged_tree(path)
    assert got(tree) == [("m", "m/a", 3), ("m", "m/a/b", 1), ("m", "m/c", 1)]
    cover = trees.child_coverage(tree, frame(spark, "caller string, callee string", ("a", "b"), ("a", "x"), ("c", "y")))
    assert got(cover) == [("m", "m/a", 1, 1), ("m", "m/a/b", 0, 0), ("m", "m/c", 0, 1)]


# text


def test_text_functions(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "c string").select(f(F.col("c"))).first()[0]
    assert one(T.memory_slot, "&gSWTimers[0].timerList[y]") == "gSWTimers[0].timerList[*]"
    assert one(T.memory_slot, "insert->fp.handlerFunc1") == "insert.fp.handlerFunc1"
    assert one(T.slot_root, "gSWTimers[0].head") == "gSWTimers"
    assert one(T.slot_aliases, "t[0].h") == ["t[0].h", "t[*].h", "t"]
    assert one(T.normalize_indirect, "a->b [ i ].c") == "a.b[*].c" and one(T.member, "a.b[*].c") == "c"
    assert one(T.sanitize_id, "operator new") == "operator_new" and one(T.sanitize_id, "") == "anon"
    assert one(T.returned_expression, " return g(x) ;") == "g(x)" and one(T.leading_dereferences, " **p") == 2
    assert one(T.call_site_id, "") == "cs_1469598103934665603" and one(T.call_site_id, None) is None


def test_text_of_calls_and_accesses(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "c string").select(f(F.col("c"))).first()[0]
    assert [one(T.canonical_slot, x) for x in ("&a->b[3].c", "*p", "struct foo *bar", "x . y", "", "int n")] == ["a.b.c", "p", "bar", "x.y", "", "n"]
    assert [one(T.callee_name, x) for x in ("x = memcpy(d, s)", "fp->run(1)", "no call")] == ["memcpy", "fp.run", ""]
    assert [one(T.assigned_slot, x) for x in ("t[i].h = f(x);", "int *p = q;", "if (a == b)", "a <= b")] == ["t[*].h", "p", "", ""]
    assert tuple(one(T.struct_access, "a->b[2].c")) == ("a", "b.c") and tuple(one(T.struct_access, "a")) == ("a", "")
    assert one(T.call_arguments, 'f(a, g(b, c), "x,)", d[1, 2]);') == ["a", "g(b, c)", '"x,)"', "d[1, 2]"]
    assert [one(T.call_arguments, x) for x in ("f()", "f", "(a)(b, c)", "f(a", None)] == [[], [], ["b", "c"], [], None]
    moved = lambda x: (lambda r: r and tuple(r))(one(T.memory_transfer, x))
    assert moved("memcpy(d, s, n);") == ("s", "d") and moved("bcopy(s, d, n)") == ("s", "d") and moved("x = __builtin_memset(&b, 0, n);") == (None, "&b")
    assert moved("f(d, s)") is None and moved("memcpy(d)") is None


# sources and sinks


def site(n, direct, callee=None):
    return {"callSiteId": f"cs_{n}", "calleeExpression": callee or direct, "directCallee": direct, "throughIdentifier": "", "argumentExpressions": [], "isIndirect": not direct, "location": {"file": "a.c", "line": n, "column": 1}}


def test_analysis_document(spark, tmp_path):
    block = [{"id": 1, "lines": ["a(); b();", "a();"], "lineCallSiteIds": [["cs_1", "cs_2"], ["cs_1", "cs_3"]], "successors": [2]}, {"id": 2, "lines": [], "lineCallSiteIds": [], "successors": []}]
    doc = {"version": 1, "functions": [{"name": "main", "entryBlockId": 1, "exitBlockId": 2, "attributes": {"callSites": [site(1, "a"), site(2, "b"), site(3, "", "fp[0].f")], "parameterNames": []}, "blocks": block}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    fns = facts.functions(spark, str(tmp_path / "a.json"))
    assert got(facts.direct_edges(fns)) == [("main", "a", "direct"), ("main", "b", "direct")]
    assert got(cfg.ordered_callees(facts.block_calls(fns))) == [("main", 1, "a,b")]
    assert got(facts.blocks(fns)) == [("main", 1, 2), ("main", 2, None)]
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(ValueError):
        facts.functions(spark, str(tmp_path / "b.json"))


def test_documents_come_back(spark, tmp_path):
    edge = frame(spark, "caller string, callee string, kind string", ("a", "b", "direct"), ("a", 'q"', "indirect"), ("a", "b", "direct"))
    sinks.callgraph_document(edge, "x").write.text(str(tmp_path / "g"))
    assert got(facts.static_edges(spark, str(tmp_path / "g"))) == [("a", 'b', "direct"), ("a", 'q"', "indirect")]
    assert '  "a" -> "q\\"" [label="indirect"];' in [r["value"] for r in sinks.graph_lines(edge, "kind").collect()]
    sig = frame(spark, "caller string, calleeExprNorm string, throughNorm string, argCount long, member string, target string", ("m", "e", "t", 1, "x", "f"), ("m", "e", "t", 1, "x", "g"), ("n", "e", "t", 1, "x", None))
    sinks.mapping_document(sig).write.text(str(tmp_path / "m"))
    assert got(facts.indirect_mapping(spark, str(tmp_path / "m")).select("caller", "target")) == [("m", "f"), ("m", "g")]


def test_name_lists(spark, tmp_path):
    (tmp_path / "n").write_text("a b # c\n\n  d  \n#x\na b\n")
    read = lambda d: [r["name"] for r in facts.name_list(spark, str(tmp_path / "n"), d).orderBy("pos", "name").collect()]
    assert read("lines") == ["a b", "d"] and read("words") == ["a", "b", "d"] and read("plain") == ["a b # c", "  d", "#x", "a b"]


def test_logs_are_read_by_file(spark, tmp_path):
    (tmp_path / "x.log").write_text("# head\nmain_entry\n\n f \nmain_exit\n")
    events = facts.read_log(spark, str(tmp_path / "x.log"), frame(spark, "name string", ("main",)))
    assert got(events.select("event_index", "line_number", "kind", "base_name")) == [(0, 2, "Entry", "main"), (1, 4, "Plain", "f"), (2, 5, "Exit", "main")]


def test_streamed_counts(spark, tmp_path):
    frame(spark, "ts timestamp, kind string, base_name string").unionByName(spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'Plain' as kind, 'f' as base_name union all select timestamp'2024-01-01 10:30:00', 'Plain', 'f' union all select timestamp'2024-01-01 10:31:00', 'Entry', 'f'")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, kind string, base_name string").parquet(str(tmp_path / "in"))
    out = streamed.plain_counts(source).writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert [(r["base_name"], r["n"]) for r in spark.table("counts").collect()] == [("f", 2)]


# paths


def program(spark):
    """main: a(), then b() or c(), any number of times; a: b() or nothing."""
    blocks = [("main", 0, 1), ("main", 1, 2), ("main", 1, 3), ("main", 2, 1), ("main", 3, 1), ("main", 1, 9), ("main", 9, None), ("a", 0, 1), ("a", 0, 9), ("a", 1, 9), ("a", 9, None)]
    calls = [("main", 0, 0, "a"), ("main", 2, 0, "b"), ("main", 3, 0, "c"), ("a", 1, 0, "b")]
    ends = [("main", 9), ("a", 9)]
    return paths.call_automaton(
        frame(spark, "fn string, block long, succ long", *blocks), frame(spark, "fn string, block long, pos int, callee string", *calls),
        frame(spark, "fn string, block long", ("main", 0), ("a", 0)), frame(spark, "fn string, block long", *ends))


def test_best_paths(spark):
    tokens = {1: "a b b", 2: "a c b", 3: "b", 4: "a", 5: "a c x", 6: "c"}
    events = frame(spark, "trace long, root string, event_index long, token string", *[(t, "main", i, x) for t, s in tokens.items() for i, x in enumerate(s.split())], (None, "main", 1, "a"), (1, "main", 9, None))
    found = paths.best_paths(events, program(spark), 3).orderBy("trace", "path_rank", "event_index").collect()
    path = lambda t, r: (next((x["score"] for x in found if (x["trace"], x["path_rank"]) == (t, r)), None), [x["caller"] for x in found if (x["trace"], x["path_rank"]) == (t, r)])
    assert path(1, 1) == (0.0, ["main", "a", "main"]) and path(1, 2) == (0.25, ["main", "main", "main"]) and path(1, 3) == (None, [])
    assert path(2, 1) == (0.0, ["main", "main", "main"]) and path(4, 1) == (0.0, ["main"])
    assert [(x["trace"], x["event_index"], x["callee"], x["problem"]) for x in found if x["path_rank"] == 0] == [(3, 0, "b", "no caller"), (5, 2, "x", "no caller"), (6, 0, "c", "no caller")]
    assert paths.best_paths(events.limit(0), program(spark)).collect() == []
    with pytest.raises(ValueError):
        paths.best_paths(events, program(spark), max_steps=2)


def test_best_combinations_equal_all_choices(spark):
    import itertools
    import random

    r = random.Random(4)
    scores = {c: sorted(r.choice([0.0, 0.25, 0.5, 1.0, 2.0]) for _ in range(r.randint(1, 3))) for c in range(6)}
    rows = frame(spark, "context long, score double", *[(c, s) for c, x in scores.items() for s in x], (None, 1.0), (3, None))
    every = sorted((sum(x), p) for x, p in (([scores[c][i] for c, i in enumerate(p)], p) for p in itertools.product(*(range(len(x)) for x in scores.values()))))
    for k in (1, 2, 5, 9):
        want = [(i + 1, t, ",".join(f"{c}:{j}" for c, j in enumerate(p) if j)) for i, (t, p) in enumerate(every[:k])]
        assert got(paths.best_combinations(rows, k)) == sorted(want, key=str)
    assert paths.best_combinations(rows.limit(0)).collect() == []


def test_coverage_tree(spark):
    tree = frame(spark, "root string, path string, hits long", ("m", "m/a", 2), ("m", "m/a/b", 1))
    static = frame(spark, "caller string, callee string", ("a", "b"), ("a", "x"), ("x", "y"), ("y", "x"), ("b", "a"))
    assert got(trees.coverage_tree(tree, static)) == [("m", "m/a", 2, True), ("m", "m/a/b", 1, True), ("m", "m/a/x", 0, False), ("m", "m/a/x/y", 0, False)]


def test_indirect_calls_are_fed_back(spark):
    """main: p = &f; (*p)(&g) at s1; f(q): (*q)() at s2, which has no arguments for h(x)."""
    args, params = frame(spark, "site string, pos int, src string", ("s1", 0, "arg")), frame(spark, "target string, pos int, dst string", ("f", 0, "q"))
    given = lambda calls: {"copy": calls.join(args, "site").join(params, ["target", "pos"]).select("src", "dst")}
    sites = frame(spark, "site string, probe string, n_args int", ("s1", "p", 1), ("s2", "q", 0))
    functions = frame(spark, "name string, n_params int", ("f", 1), ("g", 0), ("h", 1))
    for probes in (None, sites.selectExpr("probe as node")):
        solver = pointsto.Solver(spark, probes).add(addr=frame(spark, "node string, obj string", ("p", "f"), ("arg", "g"), ("arg", "h")))
        assert got(pointsto.resolve_calls(solver, sites, functions, given)) == [("s1", "f"), ("s2", "g")]


def random_constraints(r, n):
    node = [f"n{i}" for i in range(n)]
    some = lambda k: sorted({(r.choice(node), r.choice(node)) for _ in range(k)})
    return {"addr": some(n), "copy": some(n), "load": some(n // 3), "store": some(n // 3), "store_seed": some(n // 6), "mem_xfer": some(n // 6)}


def closed(c):
    """The least sets, by going over everything until nothing changes."""
    pts, link = set(c["addr"]), set(c["copy"])
    while True:
        links = {(o, d) for p, d in c["load"] for q, o in pts if q == p} | {(s, o) for p, s in c["store"] for q, o in pts if q == p}
        links |= {(a, b) for sp, dp in c["mem_xfer"] for p, a in pts if p == sp for q, b in pts if q == dp}
        more = {(d, o) for s, d in link | links for n, o in pts if n == s} | {(o, t) for p, t in c["store_seed"] for q, o in pts if q == p}
        if links <= link and more <= pts:
            return pts
        link, pts = link | links, pts | more


def led_to(pts, probe):
    seen, todo = set(), [probe]
    while todo:
        at = todo.pop()
        new = {o for n, o in pts if n == at} - seen
        seen |= new
        todo += new
    return seen


def relations(spark, c):
    return {k: frame(spark, ", ".join(f"{x} string" for x in pointsto.COLUMNS[k]), *v) for k, v in c.items()}


@pytest.mark.parametrize("seed", range(1))
def test_a_solver_goes_on_from_where_it_was(spark, seed):
    c = random_constraints(random.Random(seed), 14)
    first, rest = {k: v[::2] for k, v in c.items()}, {k: v[1::2] for k, v in c.items()}
    solver = pointsto.Solver(spark).add(**relations(spark, first))
    assert set(got(solver.solve())) == closed(first)
    assert set(got(solver.add(**relations(spark, rest)).solve())) == closed(c)
    rounds = solver.rounds
    assert set(got(solver.add(**relations(spark, c)).solve())) == closed(c) and solver.rounds == rounds  # nothing is new


@pytest.mark.parametrize("seed", range(1))
def test_a_solver_with_probes_leads_to_the_same(spark, seed):
    c = random_constraints(random.Random(seed + 10), 14)
    whole, probe = closed(c), ["n1", "n5"]
    probes = frame(spark, "node string", *((p,) for p in probe))
    first, rest = {k: v[::2] for k, v in c.items()}, {k: v[1::2] for k, v in c.items()}
    solver = pointsto.Solver(spark, probes).add(**relations(spark, first))
    solver.solve()
    found = set(got(solver.add(**relations(spark, rest)).solve()))
    assert found <= whole and all(led_to(found, p) == led_to(whole, p) for p in probe)
    targets = pointsto.Targets(solver, probes).follow()
    assert {tuple(t) for t in got(targets)} == {(p, o) for p in probe for o in led_to(whole, p)} - {(p, p) for p in probe}


def test_what_no_probe_needs_stays_out(spark):
    rows = relations(spark, {"addr": [("a", "f"), ("x", "g"), ("y", "h")], "copy": [("a", "b"), ("x", "y"), ("y", "x")], "load": [("x", "z")], "store": [], "store_seed": [], "mem_xfer": []})
    assert got(pointsto.points_to(**rows, probes=frame(spark, "node string", ("b",)))) == [("a", "f"), ("b", "f")]


def test_streamed_runs_close_across_batches(spark, tmp_path):
    events = log(spark, "main_entry f ISR_entry g ISR_exit h other_entry main_exit f_exit", ["main", "ISR", "other"])
    rows = events.select("trace", "event_index", "kind", "base_name").orderBy("event_index").collect()
    for n, part in enumerate((rows[:4], rows[4:6], rows[3:])):
        spark.createDataFrame(part, "trace long, event_index long, kind string, base_name string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("trace long, event_index long, kind string, base_name string").parquet(str(tmp_path / "in"))
        query = streamed.closed_runs(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    found = got(spark.read.parquet(str(tmp_path / "out")).select("entrypoint", "start", "parent_start", "end", "owned", "forced"))
    assert found == got(runs.context_runs(events).select("entrypoint", "start", "parent_start", "end", "owned", "forced"))


# folds over characters


def plain_arguments(text):
    depth, quote, start, parts, found = 0, "", 0, [], []
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote and text[i - 1] != "\\" else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([{":
            start, parts = (i + 1, []) if depth == 0 else (start, parts)
            depth += 1
        elif ch in ")]}" and depth:
            depth -= 1
            if depth == 0 and ch == ")":
                found = [*parts, text[start:i]]
        elif ch == "," and depth == 1:
            parts.append(text[start:i])
            start = i + 1
    found = [x.strip() for x in found]
    return [] if found == [""] else found


def plain_site(text):
    h = T.FNV_BASIS
    for b in text.encode():
        h = (h ^ b) * T.FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return f"cs_{h}"


def test_folds_over_characters(spark):
    r = random.Random(8)
    texts = ["", "f()", "f(a, g(b, c), h[1, 2])", "x = f(')', \"a,b\\\"\", c);", "f(a)(b, c)", "a, b", "f(é, 😀漢)", "(", ")("] + ["".join(r.choice("f(),[]{}'\"\\ ab😀") for _ in range(20)) for _ in range(200)]
    out = frame(spark, "t string", *[(t,) for t in texts], (None,)).select("t", T.call_arguments(F.col("t")).alias("a"), T.call_site_id(F.col("t")).alias("s")).collect()
    for t, a, site in out:
        assert (a, site) == ((None, None) if t is None else (plain_arguments(t), plain_site(t))), t


def test_conditional_expressions(spark):
    texts = {
        "x = a ? b : c;": ("x", "a", "b", "c"), "t[i] = (n > 1 ? f(a ? 1 : 2) : g);": ("t[*]", "n > 1", "f(a ? 1 : 2)", "g"), "x = a ? b ? 1 : 2 : 3": ("x", "a", "b ? 1 : 2", "3"),
        "x = (a) + (b);": None, "x == a ? b : c": None, "f(a ? b : c);": None, "": None,
    }
    got_ = {t: v for t, v in frame(spark, "t string", *[(t,) for t in texts]).select("t", T.conditional_store(F.col("t"))).collect()}
    assert {t: v and tuple(v) for t, v in got_.items()} == texts
    trimmed = frame(spark, "t string", ("((a))",), ("(a)(b)",), ("(a",), ("()",), ("",)).select("t", T.stripped_parentheses(F.col("t"))).collect()
    assert dict(map(tuple, trimmed)) == {"((a))": "a", "(a)(b)": "(a)(b)", "(a": "(a", "()": "", "": ""}


def test_small_text_functions(spark):
    row = frame(spark, "a string, xs array<string>, n int", ("log.txt", ["p", "q"], 7)).select(
        T.strip_suffix(F.col("a"), ".txt"), T.strip_suffix(F.col("a"), ".c"), T.replace_all(F.col("a"), "t", "T"), T.replace_all(F.col("a"), "", "x"), T.escape_script(F.lit("<a&b>")), T.slot_of_object(F.lit("obj:l:f:s.m")),
        T.joined_or_none(F.col("xs")), T.joined_or_none(F.lit(None).cast("array<string>")), T.is_integer_binding(F.lit("#int:4")), T.program_point(F.col("n"), F.lit(-1)), T.aligned(F.col("xs"), F.array(F.lit(1), F.lit(2), F.lit(3))), T.slot_of(F.lit("&p->q[i].r")),
    ).first()
    assert tuple(row) == ("log", "log.txt", "log.TxT", "log.txt", "\\u003ca\\u0026b\\u003e", "s.m", "p, q", "<none>", True, (7 << 32) | 0xFFFFFFFF, ["p", "q", None], "p.q[*].r")


# reports


def test_selections_of_reports(spark):
    assert [reports.path_of_rank(*x) for x in (("a/b.json", 2, 3), ("a/b.json", 1, 1), ("a.d/b", 0, 2))] == ["a/b.rank2.json", "a/b.json", "a.d/b.rank0"]
    rows = frame(spark, "fn string, pos int, lhs string, rhs string", ("f", 0, "x", "y"))
    every = frame(spark, "pos int, lhs string, rhs string", (0, "g_a", "h"), (1, "g_b", None))
    assert got(reports.with_globals(rows, every, frame(spark, "name string", ("f",), ("k",)))) == [("f", 0, "g_a", "h"), ("f", 1, "g_b", None), ("f", 2, "x", "y"), ("k", 0, "g_a", "h"), ("k", 1, "g_b", None)]
    with pytest.raises(ValueError):
        reports.with_globals(rows, every, frame(spark, "name string", ("f",)), most=1)
    assert got(reports.named(rows, "fn", ["g"])) == [] and reports.named(rows, "fn", []).count() == 1
    calls, parts = frame(spark, "trace int, event_index int", (1, 2), (1, 5), (2, 2)), frame(spark, "trace int, segment int, start int, stop int", (1, 0, 2, 4), (1, 1, 5, 5))
    assert got(reports.in_segment(calls, parts)) == [(1, 2, 0), (1, 5, 1)]
    taken = frame(spark, "assigned string, takes_address boolean", ("f", True), ("f", True), ("g", False), ("x", True), (None, True))
    assert got(reports.address_taken(taken, frame(spark, "name string", ("f",), ("g",)))) == [("f",)]
