"""Call edges as relations: projections, filters, joins, aggregates and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.loops import staged

UNKNOWN = "__unknown_indirect_target__"


def collapsed(edges: DataFrame) -> DataFrame:
    """The set of caller, callee, kind."""
    return edges.select("caller", "callee", "kind").distinct()


def edge_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("caller", "callee").agg(F.count("*").alias("n"))


def merged_counts(counts: DataFrame) -> DataFrame:
    """Sums of the partial counts caller, callee, n of several contexts."""
    return counts.groupBy("caller", "callee").agg(F.sum("n").cast("long").alias("n"))


def uncovered(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """Static edges never called, whatever their kind."""
    return static.select("caller", "callee").distinct().join(runtime.select("caller", "callee").distinct(), ["caller", "callee"], "left_anti")


def covered(static: DataFrame, runtime: DataFrame) -> DataFrame:
    return static.select("caller", "callee").distinct().join(runtime.select("caller", "callee").distinct(), ["caller", "callee"], "left_semi")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("caller", "callee")).alias("node")).distinct()


def coverage_summary(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """One row of totals and the share of static edges that were called; one shuffle by edge, one by node."""
    both = static.select("caller", "callee", F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(runtime.select("caller", "callee", F.lit(0).alias("s"), F.lit(1).alias("r")))
    edge = both.groupBy("caller", "callee").agg(F.max("s").alias("s"), F.max("r").alias("r"))
    per_edge = edge.agg(F.sum("s").alias("static_edges"), F.sum("r").alias("runtime_edges"), F.sum(F.expr("case when s = 1 and r = 0 then 1 else 0 end")).alias("uncovered_edges"))
    node = edge.select(F.explode(F.array("caller", "callee")).alias("node"), "s", "r").groupBy("node").agg(F.max("s").alias("s"), F.max("r").alias("r"))
    per_node = node.agg(F.sum("s").alias("static_nodes"), F.sum("r").alias("runtime_nodes"))
    percent = F.when(F.col("static_edges") == 0, 0.0).otherwise(100.0 * (F.col("static_edges") - F.col("uncovered_edges")) / F.col("static_edges"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("static_edges", "runtime_edges", "uncovered_edges", "static_nodes", "runtime_nodes")]
    return per_edge.crossJoin(per_node).select(*zero).withColumn("coverage_percent", F.round(percent, 6))  # one row each


def callers_by_callee(edges: DataFrame) -> DataFrame:
    """callee and its distinct callers, sorted."""
    return edges.select("caller", "callee").distinct().groupBy("callee").agg(F.array_join(F.array_sort(F.collect_list("caller")), ",").alias("callers"))


def in_degree(edges: DataFrame) -> DataFrame:
    """Every node with the number of calls (a bag count) that reach it."""
    tagged = edges.select(F.explode(F.array(F.struct(F.col("callee").alias("node"), F.lit(1).alias("k")), F.struct(F.col("caller").alias("node"), F.lit(0).alias("k")))).alias("x"))
    return tagged.groupBy("x.node").agg(F.sum("x.k").cast("long").alias("in_degree"))


def roots(edges: DataFrame) -> DataFrame:
    """Callers without callers; where there is none, the first name."""
    degree = in_degree(edges)
    free = degree.where("in_degree = 0").select("node")
    none = degree.agg(F.min("node").alias("node"), F.min("in_degree").alias("low")).where("low > 0").select("node")
    return free.unionByName(none)


def sorted_adjacency(edges: DataFrame) -> DataFrame:
    out = collapsed(edges).groupBy("caller").agg(F.array_sort(F.collect_list(F.struct("callee", "kind"))).alias("a"))
    return out.select("caller", F.expr("array_join(transform(a, x -> concat(x.callee, ':', x.kind)), ',')").alias("out_edges"))


def callgraph_summary(edges: DataFrame) -> DataFrame:
    edge = collapsed(edges)
    counts = edge.agg(F.count("*").alias("collapsed_edges"), F.count_if(F.col("kind") == "indirect-unknown").alias("unresolved_edges"))
    return counts.crossJoin(nodes(edge).agg(F.count("*").alias("functions")))


def without(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """rows whose column is no name of the blacklist. Spark broadcasts the list where its statistics allow it."""
    return rows.join(names.select(F.col("name").alias(column)).distinct(), column, "left_anti").select(*rows.columns)


def fitting_targets(sites: DataFrame, targets: DataFrame) -> DataFrame:
    """sites: site, callee, n_args. targets: callee, n_params (null where unknown). Sites whose arguments fill the parameters; an unknown profile fits."""
    return sites.join(targets, "callee", "left").where("n_params is null or n_args >= n_params").select("site", "callee")


def resolve_by_mapping(sites: DataFrame, mapping: DataFrame, signature: list[str]) -> DataFrame:
    """Left join of call sites with a precomputed mapping; a miss becomes an edge to the unknown target."""
    found = sites.join(mapping, signature, "left")
    return found.select("site", F.coalesce("target", F.lit(UNKNOWN)).alias("target"), F.when(F.col("target").isNull(), "indirect-unknown").otherwise("indirect").alias("kind"))


def bind_arguments(args: DataFrame, params: DataFrame) -> DataFrame:
    """args: callee, site, args (array). params: callee, params (array). One row for each position that both have."""
    a = args.select("callee", "site", F.posexplode("args").alias("pos", "arg"))
    p = params.select("callee", F.posexplode("params").alias("pos", "param"))
    return a.join(p, ["callee", "pos"]).select("site", "callee", F.col("pos").cast("long").alias("pos"), "arg", "param")


def static_callers(candidates: DataFrame, static: DataFrame, fallback: str = "<indirect-call>") -> DataFrame:
    """candidates: token, caller. Those that are static callers of the token; callers of the fallback only where the token has no static caller at all."""
    edge = static.select(F.col("callee").alias("token"), "caller").distinct()
    direct = candidates.join(edge, ["token", "caller"], "left_semi")
    any_caller = edge.where(F.col("token") == fallback).select("caller")
    rest = candidates.join(edge.select("token").distinct(), "token", "left_anti").join(any_caller, "caller", "left_semi")
    return direct.unionByName(rest.select(*direct.columns))


def unresolved(sites: DataFrame, resolved: DataFrame, key: list[str]) -> DataFrame:
    """Call sites without a resolved edge, one for each key."""
    return sites.select(*key).distinct().join(resolved.select(*key).distinct(), key, "left_anti")


def first_nonempty(candidates: DataFrame) -> DataFrame:
    """candidates: site, step, target. The targets of each site's first step that has any."""
    first = candidates.groupBy("site").agg(F.min("step").alias("step"))
    return candidates.join(first, ["site", "step"]).select("site", "step", "target").distinct()


def prefix_descendants(slots: DataFrame) -> DataFrame:
    """slots: slot, a path like a.b[0].c. Pairs of a slot and each slot below it, by exploding prefixes and joining on them."""
    parts = F.expr(r"regexp_extract_all(slot, '(\\[[^\\]]*\\]|[.]?[^.\\[]+)', 1)")
    paths = slots.withColumn("p", parts).where("size(p) > 1")
    prefixes = paths.select("slot", F.explode(F.expr("transform(sequence(1, size(p) - 1), i -> array_join(slice(p, 1, i), ''))")).alias("prefix"))
    return prefixes.join(slots.select(F.col("slot").alias("prefix")).distinct(), "prefix", "left_semi").select(F.col("prefix").alias("ancestor"), F.col("slot").alias("descendant")).distinct()


def same_member(sites: DataFrame, entries: DataFrame) -> DataFrame:
    """sites: site, slot. entries: slot, target. Targets of entries with the site's root and last member, as an equi-join on both."""
    root = lambda c: F.regexp_extract(c, r"^([^.\[]*)", 1)
    member = lambda c: F.regexp_extract(c, r"\.([^.\[\]]+)$", 1)
    told = lambda rows, name: rows.select(name, root("slot").alias("root"), member("slot").alias("member")).where("member <> ''").distinct()
    return paired(told(sites, "site"), told(entries, "target"), "site", "target", ["root", "member"])


def paired(a: DataFrame, b: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """a: left, keys. b: right, keys. Rows each once. The distinct pairs left, right with equal keys.

    A pair can come twice only where both of its sides have several keys: only such pairs are compared, all others are written as
    they are joined. There may be far more pairs than rows, so the rows are dealt out by their keys into as many tasks as the
    session gives shuffles, however few bytes they are; where there are fewer keys than tasks, each key goes to several, with all
    rows of b and a share of those of a.
    """
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = -(-2 * n // max(1, b.select(*keys).distinct().limit(2 * n).count()))

    def counted(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        rows = staged(rows.withColumn("many", F.count("*").over(Window.partitionBy(name)) > 1))
        return rows.where("not many").drop("many"), rows.where("many").drop("many")

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.withColumn("share", F.pmod(F.xxhash64(left), F.lit(shares)).cast("int")), y.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        on = [*keys, "share"]
        return x.repartition(n, *on).join(y.repartition(n, *on).hint("merge"), on).select(left, right)

    (one_a, many_a), (one_b, many_b) = counted(a, left), counted(b, right)
    return met(one_a, one_b.unionByName(many_b)).unionByName(met(many_a, one_b)).unionByName(met(many_a, many_b).distinct())


def node_coverage(paths: DataFrame, functions: DataFrame) -> DataFrame:
    """paths: rank, node. For each function whether any and whether every kept path covers it."""
    n = paths.agg(F.countDistinct("rank").alias("n"))
    seen = paths.groupBy("node").agg(F.countDistinct("rank").alias("k"))
    return functions.join(seen, "node", "left").crossJoin(F.broadcast(n)).select("node", F.col("k").isNotNull().alias("by_any"), F.coalesce(F.col("k") == F.col("n"), F.lit(False)).alias("by_all"))


def mapping_summary(sites: DataFrame) -> DataFrame:
    """sites: site, targets (array). Total, resolved and unresolved sites."""
    return sites.agg(F.count("*").alias("total"), F.count_if(F.size("targets") > 0).alias("resolved"), F.count_if(F.coalesce(F.size("targets"), F.lit(0)) <= 0).alias("unresolved"))


def failure_reasons(failures: DataFrame) -> DataFrame:
    """Histogram of reason, with its place by (count desc, reason)."""
    from pyspark.sql import Window

    counts = failures.groupBy("reason").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "reason")).cast("long"))  # as many rows as reasons
