"""Logs in parts, and documents written in parts and read back."""

import json

from flowlens.operators import edges, runs
from flowlens.sources import facts, sinks


def written(lines, folder):
    """The document of a folder's parts, one after the other."""
    sinks.write_document(lines, str(folder))
    return json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))


def test_lines_of_split_files_are_numbered_through(spark, tmp_path):
    logs = {name: [f"{'  ' if i % 7 == 0 else ''}{name}_{i}" if i % 5 else "" if i % 2 else "# note" for i in range(n)] for name, n in (("one", 4000), ("two", 3), ("three", 1))}
    for name, lines in logs.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n" * (name == "one"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {(r["file"].rsplit("/", 1)[1], r["line_number"]): (r["value"], r["part"]) for r in facts.numbered_lines(spark, str(tmp_path)).collect()}
        events = facts.read_log(spark, str(tmp_path / "one"), spark.createDataFrame([("main",)], "name string")).orderBy("event_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k: v for k, (v, _) in got.items()} == {(n, i): v for n, lines in logs.items() for i, v in enumerate(lines, 1)}
    assert len({p for (n, _), (_, p) in got.items() if n == "one"}) > 3
    kept = [(i, v.strip()) for i, v in enumerate(logs["one"], 1) if v.strip() and not v.startswith("#")]
    assert [(r["event_index"], r["line_number"], r["raw_token"]) for r in events] == [(k, i, v) for k, (i, v) in enumerate(kept)]


def test_a_log_becomes_a_runtime_document_and_that_a_diff(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join("main_entry a isr_entry b isr_exit c main_exit isr_entry d isr_exit".split()))
    events = facts.read_log(spark, str(tmp_path / "log"), spark.createDataFrame([("main",), ("isr",)], "name string"))
    run = runs.context_runs(events)
    above = run.selectExpr("trace as t", "start as s", "context_id as parent_id")
    contexts = run.join(above, (run["trace"] == above["t"]) & (run["parent_start"] == above["s"]), "left").select("context_id", "entrypoint", "ordinal", "parent_id", "start", "end")
    owner = runs.owners(events).join(run.selectExpr("trace", "start as run_start", "context_id", "entrypoint"), ["trace", "run_start"])
    calls = events.where("kind = 'Plain'").join(owner, ["trace", "event_index"]).selectExpr("context_id", "event_index", "line_number as line", "entrypoint as caller", "cast(null as bigint) as depth", "base_name as callee")
    document = written(sinks.runtime_lines(contexts, calls, {"events": events.count()}), tmp_path / "runtime")
    found = document["contextProcessing"]["contexts"]
    assert [(c["contextId"], c.get("parentContextId"), [k["callee"] for k in c["calls"]]) for c in found] == [("main#1@0", None, ["a", "c"]), ("isr#1@2", "main#1@0", ["b"]), ("isr#2@7", None, ["d"])]
    assert document["summary"] == {"events": 10} and "callerDepth" not in found[0]["calls"][0]
    (tmp_path / "runtime.json").write_text(json.dumps(document))
    again = facts.runtime_calls(spark, str(tmp_path / "runtime.json"))
    static = spark.createDataFrame([("main", "a", "direct"), ("main", "x", "direct"), ("isr", 'q"\\', "indirect")], "caller string, callee string, kind string")
    assert sorted(map(tuple, edges.uncovered(static, again).collect())) == sorted(map(tuple, edges.uncovered(static, calls).collect())) == [("isr", 'q"\\'), ("main", "x")]
    diff = written(sinks.diff_lines(edges.coverage_summary(static, again), edges.uncovered(static, again)), tmp_path / "diff")
    assert diff["uncoveredEdges"] == [{"caller": "isr", "callee": 'q"\\'}, {"caller": "main", "callee": "x"}] and diff["uncoveredCallers"] == ["isr", "main"] and diff["summary"]["uncovered_edges"] == 2
    graph = written(sinks.callgraph_lines(static, "a.json", spark.createDataFrame([("s1", "main", "fp")], "site string, caller string, calleeExpression string")), tmp_path / "graph")
    assert graph["summary"] == {"functionCount": 5, "collapsedEdgeCount": 3, "unresolvedIndirectCallCount": 1} and graph["collapsedCallGraph"]["nodes"] == sorted(["main", "a", "x", "isr", 'q"\\'])
    (tmp_path / "graph.json").write_text(json.dumps(graph))
    assert sorted(map(tuple, facts.static_edges(spark, str(tmp_path / "graph.json")).collect())) == sorted(map(tuple, static.collect()))
    empty = written(sinks.callgraph_lines(static.limit(0)), tmp_path / "none")
    assert empty["collapsedCallGraph"] == {"nodes": [], "edges": []}


def test_an_analysis_is_written_as_it_was_read(spark, tmp_path):
    functions = [{"name": f"f{i}", "entryBlockId": 0, "exitBlockId": 1, "attributes": {"parameterNames": ["a"] * (i % 3)}, "blocks": [{"id": 0, "lines": [f"x = {i};"], "successors": [1]}]} for i in range(30)]
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "functions": functions}))
    document = written(sinks.analysis_lines(facts.functions(spark, str(tmp_path / "a.json"))), tmp_path / "out")
    assert document == {"version": 1, "functions": functions}


def test_a_mapping_is_written_with_its_counts_and_read_back(spark, tmp_path):
    rows = [("s1", "main", "p.cb", "p", 1, "cb", "f"), ("s1", "main", "p.cb", "p", 1, "cb", "g"), ("s2", "main", "p.cb", "p", 1, "cb", "g"), ("s3", "main", "q", "q", 0, "", None), ("s4", "work", "q", "q", 2, "", "f")]
    resolved = spark.createDataFrame(rows, "site string, caller string, calleeExprNorm string, throughNorm string, argCount long, member string, target string")
    document = written(sinks.mapping_lines(resolved, "a.json"), tmp_path / "mapping")
    assert document["summary"] == {"totalCallsites": 4, "resolvedCallsites": 3, "unresolvedCallsites": 1}
    assert [(e["signature"]["calleeExprNorm"], e["signature"]["argCount"], e["targets"]) for e in document["entries"]] == [("p.cb", 1, ["f", "g"]), ("q", 0, []), ("q", 2, ["f"])]
    (tmp_path / "m.json").write_text(json.dumps(document))
    assert sorted(map(tuple, facts.indirect_mapping(spark, str(tmp_path / "m.json")).collect())) == sorted({r[1:] for r in rows if r[-1]})
