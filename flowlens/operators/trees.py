"""Occurrence trees of calls, coverage of their nodes, and candidate ranking.

A tree is a set of rows root, path (names from the root, joined by '/'), hits. The fold that turns ordered calls into paths
streams over sorted partitions and holds one stack.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PATHS = "context_id long, event_index long, path string, depth long"


def _paths(batches):
    context, stack = None, []
    for batch in batches:
        out = []
        for c, i, caller, callee in zip(batch["context_id"].tolist(), batch["event_index"].tolist(), batch["caller"].tolist(), batch["callee"].tolist()):
            if c != context:
                context, stack = c, [caller]
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k] == caller), 0)
            del stack[at + 1 :]
            stack.append(callee)
            out.append((c, i, "/".join(stack), len(stack) - 1))
        yield pd.DataFrame(out, columns=["context_id", "event_index", "path", "depth"])


def call_paths(calls: DataFrame) -> DataFrame:
    """calls: context_id, event_index, caller, callee. The path of each call: the stack is cut to the nearest frame of the caller, else to the root (the first caller)."""
    rows = calls.select(F.col("context_id").cast("long").alias("context_id"), F.col("event_index").cast("long").alias("event_index"), "caller", "callee").where("context_id is not null")
    return rows.repartition("context_id").sortWithinPartitions("context_id", "event_index", "caller", "callee").mapInPandas(_paths, PATHS)


def merged_tree(paths: DataFrame) -> DataFrame:
    """root, path, hits over all contexts of a root."""
    return paths.groupBy(F.substring_index("path", "/", 1).alias("root"), "path").agg(F.count("*").alias("hits"))


def child_coverage(tree: DataFrame, static: DataFrame) -> DataFrame:
    """For each node of the tree the number of its static callees that are its children there, and of those that are not."""
    name = F.element_at(F.split("path", "/"), -1)
    node = tree.select("root", "path", name.alias("name"))
    children = tree.select("root", F.expr("regexp_extract(path, '^(.*)/[^/]*$', 1)").alias("path"), name.alias("callee")).where("path <> ''").withColumn("seen", F.lit(1))
    edge = static.select(F.col("caller").alias("name"), "callee").distinct()
    both = node.join(edge, "name", "left").join(children, ["root", "path", "callee"], "left")
    return both.groupBy("root", "path").agg(F.count_if(F.col("seen") == 1).alias("covered"), F.count_if(F.col("callee").isNotNull() & F.col("seen").isNull()).alias("missed"))


def coverage_tree(tree: DataFrame, static: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, path, hits, taken: the tree, and below it the static callees that were never taken there, and theirs in turn.

    A name that stands on the path already is not expanded again, so recursive programs end. The rows are as many as the
    static call paths below the tree: in a dense graph max_depth bounds how far below it they go.
    """
    from flowlens.operators.loops import grow, staged

    edge = staged(static.select(F.col("caller").alias("name"), "callee").distinct())
    taken = staged(tree.select("root", "path", "hits"))

    def below(nodes: DataFrame) -> DataFrame:
        nodes = nodes if max_depth is None else nodes.where(F.col("level") < max_depth)
        last = nodes.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(edge, "name")
        return last.where("not array_contains(split(path, '/'), callee)").select("root", F.concat_ws("/", "path", "callee").alias("path"), F.expr("level + 1").alias("level"))

    first = below(taken.select("root", "path", F.lit(0).alias("level"))).join(taken.select("root", "path"), ["root", "path"], "left_anti")
    missed = grow(first, below, ["root", "path"]).select("root", "path")
    return taken.withColumn("taken", F.lit(True)).unionByName(missed.withColumns({"hits": F.lit(0).cast("long"), "taken": F.lit(False)}))


def root_summary(covered: DataFrame) -> DataFrame:
    out = covered.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("covered").alias("covered"), F.sum("missed").alias("missed"))
    return out.withColumn("percent", F.round(F.expr("case when covered + missed = 0 then 100.0D else 100.0D * covered / (covered + missed) end"), 6))


def preorder(tree: DataFrame) -> DataFrame:
    """Each root's nodes (each path once) numbered in path order, with the number of the parent.

    Paths are dealt out by root once: a node's own row and those of its children meet in a window within the root.
    """
    names = F.split("path", "/")
    out = tree.select("root", "path", names.alias("fw_names")).withColumn("n", (F.row_number().over(Window.partitionBy("root").orderBy("fw_names")) - 1).cast("long"))
    out = out.withColumns({"level": (F.size("fw_names") - 1).cast("long"), "above": F.expr("regexp_extract(path, '^(.*)/[^/]*$', 1)")})
    each = out.select("root", "path", "n", "level", F.explode(F.array(F.struct(F.col("above").alias("of"), F.lit(False).alias("own")), F.struct(F.col("path").alias("of"), F.lit(True).alias("own")))).alias("x")).select("root", "path", "n", "level", "x.*")
    parent = F.when(F.col("root").isNotNull() & F.col("of").isNotNull(), F.max(F.when(F.col("own"), F.col("n"))).over(Window.partitionBy("root", "of")))
    return each.withColumn("parent", parent).where("not own").select("root", "path", "n", "level", "parent")


def rank_callers(candidates: DataFrame) -> DataFrame:
    """candidates: trace, event_index, caller, depth. The rank by (depth, caller) and its cost, a quarter for each place; lower is better."""
    w = Window.partitionBy("trace", "event_index").orderBy("depth", "caller")
    return candidates.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).withColumn("delta", F.col("rank") * 0.25)


def top_k(scored: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """The k first rows of each group by order; Spark keeps k rows a task before the shuffle."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("place") <= k)


def best_total(ranked: DataFrame) -> DataFrame:
    """The least total of each trace, with the number of events that had a choice."""
    event = ranked.groupBy("trace", "event_index").agg(F.min("delta").alias("delta"), F.count("*").alias("choices"))
    return event.groupBy("trace").agg(F.sum("delta").alias("score"), F.count("*").alias("events"), F.count_if(F.col("choices") > 1).alias("ambiguous"))
