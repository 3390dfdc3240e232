"""What queries write and compare: whole results from joins that move little."""

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowlens.functions import text as T
from flowlens.operators import edges, loops, resolve, trees
from flowlens.plans import catalog

SF = "/root/testdata/sf0.001"


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def rows_written(spark, make):
    """Rows that a query writes under the shared folder while it is made and read."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    parts = lambda: {os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}
    before = parts()
    out = got(make())
    new = sorted(parts() - before)
    return out, sum(spark.read.parquet(f).count() for f in new)


def contexts(pairs, roots, depth):
    """Contexts by a search that keeps lists of names."""
    todo = [(r, ()) for r in roots]
    seen = set(todo)
    while todo:
        fn, ctx = todo.pop()
        for a, b in pairs:
            if a == fn and (x := (b, (*ctx, fn)[-depth:])) not in seen:
                seen.add(x)
                todo.append(x)
    return {(fn, ">".join(c)) for fn, c in seen}


def test_contexts_are_joined_and_not_kept(spark):
    pairs = {(f"p{i}", f"p{j}") for i in range(12) for j in range(12) if (i * j) % 3 != 1} | {("z", "zz"), ("root", "p1"), ("top", "root"), ("p3", "p3")}
    edge, root = frame(spark, "caller string, callee string", *pairs), frame(spark, "node string", ("top",), ("p5",))
    for depth in (1, 3):
        want = contexts(pairs, ["top", "p5"], depth)
        found, kept = rows_written(spark, lambda n=depth: loops.bounded_contexts(edge, root, n)[0])
        assert found == sorted(want) and kept < 4 * len(pairs)
        rows = defaultdict(list)
        for fn, ctx in want:
            rows[fn].append(ctx)
        told, kept = rows_written(spark, lambda n=depth: loops.bounded_context_totals(edge, root, n))
        assert told == sorted((a, b, len(c), min(c), max(c), sum(map(len, c))) for a, b in pairs if (c := rows.get(a))) and kept < 4 * len(pairs)


def test_names_that_hold_the_mark_give_each_context_once(spark):
    pairs = {("a", "b>c"), ("b>c", "d"), ("a>b", "c"), ("c", "d"), ("", "a"), ("a", "a>b"), ("x", "a")}
    edge, root = frame(spark, "caller string, callee string", *pairs), frame(spark, "node string", ("",), ("x",))
    want = contexts(pairs, ["", "x"], 2)
    assert got(loops.bounded_contexts(edge, root)[0]) == sorted(want)
    told = {(a, b): n for a, b, n, *_ in got(loops.bounded_context_totals(edge, root))}
    assert told == {(a, b): n for a, b in pairs if (n := sum(fn == a for fn, _ in want))}


def test_plain_texts_are_split_as_a_fold_splits_them(spark):
    texts = ["c ? a : b", " (c ? a : b) ", "( x )", "()", "(a)(b)", "((a) ? b : c)", "a ? b ? c : d : e", "a:b ? c : d : e", "a ? b", "a : b", "", None, " ", "f(x) ? a[1] : {b}", "a)", "(a", "f(x) )", "\t(\nc ?a:b\r)", "?:", "a ?: b", "x ? y : z ? p : q", "é ? ß : "]
    rows = frame(spark, "s string", *((t,) for t in texts))
    split, fold = T.top_level_split(F.col("s")), T.bound(T.stripped_parentheses(F.col("s")), T._split)
    for r in rows.select("s", T.stripped_parentheses(F.col("s")).alias("a"), T._counted_parentheses(T.trim(F.col("s"))).alias("b"), split.alias("c"), fold.alias("d")).collect():
        assert (r["a"], r["c"]) == (r["b"], r["d"]), r["s"]


def test_lines_are_dealt_out_and_sorted_once(spark, tmp_path):
    rows = [(o, n, 1 + o % 3, 1 + n % 2) for o in range(20) for n in range(1, 5)]
    frame(spark, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", *rows).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = catalog.QUERIES["folded_lines"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1


def test_pairs_of_equal_keys_come_once(spark):
    sites = [(1, "r.m"), (1, "r.x.m"), (2, "r[0].n"), (3, "q.m"), (3, "r.n"), (4, "r"), (2, "r.n"), (5, None)]
    entries = [(7, "r.m"), (7, "r.a.m"), (8, "q.m"), (8, "r.m"), (9, "r.n"), (9, "q.m"), (9, "r.n")]
    key = lambda s: (s.split(".")[0].split("[")[0], s.split(".")[-1]) if s and "." in s else None
    want = sorted({(a, b) for a, s in sites for b, t in entries if key(s) and key(s) == key(t)})
    found = edges.same_member(frame(spark, "site long, slot string", *sites), frame(spark, "target long, slot string", *entries))
    assert got(found) == want
    # what is compared after a join are the pairs of sides with several keys alone
    single = edges.same_member(frame(spark, "site long, slot string", *((i, "r.m") for i in range(40))), frame(spark, "target long, slot string", *((i, "r.m") for i in range(50))))
    assert single.count() == 2000
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


@pytest.mark.parametrize("name", ["return_constraints", "transfer_constraints", "argument_constraints", "field_collapse"])
def test_constraints_write_nothing_but_the_global_slots(spark, name):
    out, kept = rows_written(spark, lambda: catalog.QUERIES[name](spark, SF))
    assert out and kept == 1  # v7 and its root are one slot


def test_assignments_are_written_once_before_their_rules(spark):
    out, kept = rows_written(spark, lambda: catalog.QUERIES["assignment_constraints"](spark, SF))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert out and kept <= lines + 1


def test_trees_are_dealt_out_by_root_once(spark):
    tree = frame(spark, "root string, path string", ("a", "a"), ("a", "a/b"), ("a", "a/b/c"), ("a", "a b"), ("a", "x/y"), ("b", "a/b"), (None, "a/b"), (None, "a"))
    found = trees.preorder(tree)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("a", "a", 0, 0, None), ("a", "a/b", 1, 1, 0), ("a", "a/b/c", 2, 2, 1), ("a", "a b", 3, 0, None), ("a", "x/y", 4, 1, None), ("b", "a/b", 0, 1, None), (None, "a", 0, 0, None), (None, "a/b", 1, 1, None)}
    assert plan.count("Exchange ") == 1


def test_slots_are_taken_apart_once(spark):
    chain = [("f", f"v{i}", f"v{i + 1}") for i in range(5)]
    slots = [("f", f"v{i}.m") for i in range(6)]
    make = lambda: resolve.transfer_slots(frame(spark, "fn string, target_slot string", ("f", "v0")), frame(spark, "fn string, lhs string, rhs string", *chain), frame(spark, "fn string, slot string", *slots))
    out, kept = rows_written(spark, make)
    assert out == sorted(("f", "v0", s) for s in [f"v{i}" for i in range(6)] + [s for _, s in slots])
    assert kept >= len(chain) + len(slots)  # the links are among what is written


def test_a_small_frontier_is_broadcast_to_the_edges(spark):
    hints = []

    def step(new):
        hints.append("ResolvedHint" in new._jdf.queryExecution().analyzed().toString())
        return new.where("n < 3").select((F.col("n") + 1).alias("n"))

    assert got(loops.grow(frame(spark, "n long", (0,)), step)) == [(0,), (1,), (2,), (3,)]
    assert hints and all(hints)


def test_pairs_of_a_cascade_are_not_kept(spark):
    sites = frame(spark, "site long, fn string, direct string, expr string", *((i, "f", None, "t[*].m") for i in range(60)), (99, "f", None, "q.z"))
    entries = frame(spark, "path string, target string", *(("p.m", f"k{i}") for i in range(70)), ("q.z", "k1"))
    none = lambda schema: frame(spark, schema)
    make = lambda: resolve.cascade(sites, none("site long, target string"), entries, none("fn string, lhs string, rhs string"), none("fn string, base string, source string"), none("slot string"), none("fn string, slot string, target string"))
    out, kept = rows_written(spark, make)
    assert out == sorted([(i, 7, f"k{j}", "indirect") for i in range(60) for j in range(70)] + [(99, 2, "k1", "indirect")]) and kept < 60 * 70
