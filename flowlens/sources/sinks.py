"""Writers: JSON documents and DOT graphs as text rows.

A document is lines in the order of (section, a, b, c): a list is a line for each element, so no row holds a table. `write_document`
sorts the lines by range and writes them in parts; the parts, one after the other, are the document. Functions that return a
document as one row `value` are for results of a report's size.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.text import escape_dot, sanitize_id


def callgraph_document(edges: DataFrame, source: str = "") -> DataFrame:
    """One row `value`: the call graph with its counts, edges sorted."""
    sides = edges.select("caller", "callee", "kind").distinct()
    body = sides.agg(F.array_sort(F.collect_set(F.struct("caller", "callee", "kind"))).alias("edges"), F.count("*").alias("n"))
    names = sides.select(F.explode(F.array("caller", "callee")).alias("n")).agg(F.array_sort(F.collect_set("n")).alias("nodes"))
    return body.crossJoin(names).select(
        F.to_json(F.struct(
            F.lit("callgraph").alias("kind"), F.lit(source).alias("input"),
            F.struct(F.size("nodes").alias("functionCount"), F.col("n").alias("collapsedEdgeCount")).alias("summary"),
            F.struct("nodes", "edges").alias("collapsedCallGraph"))).alias("value"))


def diff_document(summary: DataFrame, uncovered: DataFrame) -> DataFrame:
    """One row `value`: coverage totals, uncovered edges, their callers and callees, all sorted."""
    lists = uncovered.agg(
        F.array_sort(F.collect_list(F.struct("caller", "callee"))).alias("uncoveredEdges"),
        F.array_sort(F.collect_set("caller")).alias("uncoveredCallers"), F.array_sort(F.collect_set("callee")).alias("uncoveredCallees"))
    return summary.crossJoin(lists).select(F.to_json(F.struct(F.lit("uncovered-callgraph").alias("kind"), F.struct(*summary.columns).alias("summary"), "uncoveredEdges", "uncoveredCallers", "uncoveredCallees")).alias("value"))


def mapping_document(resolved: DataFrame, source: str = "") -> DataFrame:
    """resolved: caller, calleeExprNorm, throughNorm, argCount, member, target (null where there is none)."""
    key = ["caller", "calleeExprNorm", "throughNorm", "argCount", "member"]
    entry = resolved.groupBy(*key).agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return entry.agg(F.array_sort(F.collect_list(F.struct(F.struct(*key).alias("signature"), "targets"))).alias("entries")).select(
        F.to_json(F.struct(F.lit("indirect-call-mapping").alias("kind"), F.lit(2).alias("schemaVersion"), F.lit(source).alias("generatedFrom"), "entries")).alias("value"))


def graph_lines(edges: DataFrame, label: str) -> DataFrame:
    """DOT lines of edges caller, callee and a label column: a row each, to be written between a head and a tail."""
    quoted = lambda c: F.concat(F.lit('"'), escape_dot(F.col(c).cast("string")), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), quoted("caller"), F.lit(" -> "), quoted("callee"), F.lit(" [label="), quoted(label), F.lit("];")).alias("value"))


def cfg_documents(blocks: DataFrame) -> DataFrame:
    """fn, value: a DOT digraph for each function."""
    edge = F.concat(F.lit("  b"), "block", F.lit(" -> b"), "succ", F.lit(";"))
    out = blocks.where("succ is not null").groupBy("fn").agg(F.array_join(F.array_sort(F.collect_set(edge)), "\n").alias("body"))
    return out.select("fn", F.concat(F.lit("digraph "), sanitize_id(F.col("fn").cast("string")), F.lit(" {\n"), "body", F.lit("\n}\n")).alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    rows.select("value").write.mode("overwrite").text(path)


_KEY = ["section", "a", "b", "c"]


def lines_of(spark: SparkSession, parts: list[str | DataFrame]) -> DataFrame:
    """section, a, b, c, value. parts, in their order: JSON text as it is, and frames a, b, c, value of a list's elements, of unique (a, b, c), which get commas between them."""
    out = []
    for i, part in enumerate(parts):
        if isinstance(part, str):
            rows = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(part).alias("value"))
        else:
            key = F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("string").alias("b"), F.col("c").cast("long").alias("c"))
            rows = part.select(key.alias("k"), "value")
            first = rows.agg(F.min("k").alias("first"))  # one row
            rows = rows.join(F.broadcast(first), F.lit(True)).select("k.*", F.concat(F.when(F.col("k") == F.col("first"), "").otherwise(","), "value").alias("value"))
        out.append(rows.withColumn("section", F.lit(i)))
    return reduce(DataFrame.unionByName, out).select(*_KEY, "value")


def write_document(lines: DataFrame, path: str) -> None:
    """lines: section, a, b, c, value. Text files of path, in the order of their names."""
    lines.orderBy(*_KEY).select("value").write.mode("overwrite").text(path)


def _elements(rows: DataFrame, value: Column, a: str | None = None, b: str | Column = "") -> DataFrame:
    """rows as elements of a list in the order of a (a number) and b (a text)."""
    text = b if isinstance(b, Column) else F.col(b) if b else F.lit("")
    return rows.select((F.col(a) if a else F.lit(0)).alias("a"), text.alias("b"), F.lit(0).alias("c"), value.alias("value"))


def callgraph_lines(edges: DataFrame, source: str = "", unresolved: DataFrame | None = None) -> DataFrame:
    """The call graph with its counts, nodes and edges sorted. unresolved: site, caller, calleeExpression of indirect calls without a target."""
    sides = edges.select("caller", "callee", "kind").distinct()
    names = sides.select(F.explode(F.array("caller", "callee")).alias("n")).distinct()
    counts = sides.agg(F.count("*").alias("e")).join(names.agg(F.count("*").alias("n")), F.lit(True)).first()
    none = edges.sparkSession.createDataFrame([], "site string, caller string, calleeExpression string")
    open_ = none if unresolved is None else unresolved.select("site", "caller", "calleeExpression").distinct()
    head = {"kind": "callgraph", "input": source, "summary": {"functionCount": counts["n"], "collapsedEdgeCount": counts["e"], "unresolvedIndirectCallCount": open_.count()}}
    return lines_of(edges.sparkSession, [
        json.dumps(head)[:-1] + ', "unresolvedIndirectCalls": [', _elements(open_, F.to_json(F.struct(F.col("site").alias("callSiteId"), "caller", "calleeExpression")), b=F.concat_ws("\0", "site", "caller", "calleeExpression")),
        '], "collapsedCallGraph": {"nodes": [', _elements(names, _quoted("n"), b="n"),
        '], "edges": [', _elements(sides, F.to_json(F.struct("caller", "callee", "kind")), b=F.concat_ws("\0", "caller", "callee", "kind")), "]}}",
    ])


def _quoted(name: str) -> Column:
    """The JSON text of a string."""
    return F.regexp_extract(F.to_json(F.struct(F.col(name).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def diff_lines(summary: DataFrame, uncovered: DataFrame) -> DataFrame:
    """Coverage totals (one row), uncovered edges, their callers and callees, all sorted."""
    edge = uncovered.select("caller", "callee").distinct()
    names = lambda c: _elements(edge.select(c).distinct(), _quoted(c), b=c)
    head = {"kind": "uncovered-callgraph", "summary": summary.first().asDict()}
    return lines_of(uncovered.sparkSession, [
        json.dumps(head)[:-1] + ', "uncoveredEdges": [', _elements(edge, F.to_json(F.struct("caller", "callee")), b=F.concat_ws("\0", "caller", "callee")),
        '], "uncoveredCallers": [', names("caller"), '], "uncoveredCallees": [', names("callee"), "]}",
    ])


def analysis_lines(functions: DataFrame) -> DataFrame:
    """functions: fn, def_pos, f as the readers give them. The analysis document, version 1; a definition is a line."""
    return lines_of(functions.sparkSession, ['{"version": 1, "functions": [', _elements(functions, F.to_json("f"), a="def_pos", b="fn"), "]}"])


def runtime_lines(contexts: DataFrame, calls: DataFrame, summary: dict | None = None) -> DataFrame:
    """contexts: context_id, entrypoint, ordinal, parent_id (null at the top), start, end. calls: context_id, event_index, line, caller, depth, callee. The runtime document; contexts by start, a line for each call.

    Keys without a value are left out.
    """
    run = contexts.select("context_id", "entrypoint", "ordinal", "parent_id", "start", "end")
    told = F.to_json(F.struct(F.col("context_id").alias("contextId"), "entrypoint", F.col("parent_id").alias("parentContextId"), "ordinal", F.col("start").alias("startIndex"), F.col("end").alias("endIndex")))
    known = calls.join(run.select("context_id", "start"), "context_id")
    first = known.groupBy("context_id").agg(F.min(F.struct("event_index", "caller", "callee")).alias("first"))
    call = F.to_json(F.struct(F.col("event_index").alias("eventIndex"), "line", "caller", F.col("depth").alias("callerDepth"), "callee"))
    comma = F.when(F.struct("event_index", "caller", "callee") == F.col("first"), "").otherwise(",")
    rank = lambda what, rest: F.concat_ws("\0", "context_id", F.lit(what), rest)
    inner = known.join(first, "context_id").select(F.col("start").alias("a"), rank("1", F.lit("")).alias("b"), F.col("event_index").alias("c"), F.concat(comma, call).alias("value"))
    low = run.agg(F.min(F.struct("start", "context_id")).alias("low"))  # one row
    opened = run.join(F.broadcast(low), F.lit(True)).select(F.col("start").alias("a"), rank("0", F.lit("")).alias("b"), F.lit(0).cast("long").alias("c"), F.concat(F.when(F.struct("start", "context_id") == F.col("low"), "").otherwise(","), F.regexp_replace(told, r"\}$", ""), F.lit(',"calls":[')).alias("value"))
    closed = run.select(F.col("start").alias("a"), rank("2", F.lit("")).alias("b"), F.lit(0).cast("long").alias("c"), F.lit("]}").alias("value"))
    spark = contexts.sparkSession
    head = lines_of(spark, [json.dumps({"summary": summary or {}})[:-1] + ', "contextProcessing": {"contexts": ['])
    body = opened.unionByName(inner).unionByName(closed).withColumn("section", F.lit(1))
    tail = lines_of(spark, ["]}}"]).withColumn("section", F.lit(2))
    return head.unionByName(body.select(*_KEY, "value")).unionByName(tail)


def mapping_lines(resolved: DataFrame, source: str = "") -> DataFrame:
    """resolved: site, caller, calleeExprNorm, throughNorm, argCount, member, target (null where a site has none). The indirect-call mapping of version 2, a line for each signature, and how many sites have a target."""
    key = ["caller", "calleeExprNorm", "throughNorm", "argCount", "member"]
    entry = resolved.groupBy(*key).agg(F.array_sort(F.collect_set("target")).alias("targets"))
    site = resolved.groupBy("site").agg(F.count("target").alias("n")).agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("resolved")).first()
    summary = {"totalCallsites": site["total"], "resolvedCallsites": site["resolved"], "unresolvedCallsites": site["total"] - site["resolved"]}
    head = {"kind": "indirect-call-mapping", "schemaVersion": 2, "generatedFrom": source, "summary": summary}
    value = F.to_json(F.struct(F.struct(*key).alias("signature"), "targets"))
    text = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return lines_of(resolved.sparkSession, [json.dumps(head)[:-1] + ', "entries": [', _elements(entry, value, b=F.concat_ws("\0", *text)), "]}"])
