"""Selections and totals behind a report: definitions, argument values, runs, segments and trees.

Null keys belong to no group and are left out where a docstring doesn't say otherwise; repeated rows count as often as they
stand, except where distinct values are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def named(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose column is one of the names; no names mean all rows."""
    return rows.where(F.col(column).isin(names)) if names else rows


def definitions(rows: DataFrame) -> DataFrame:
    """rows: fn, file, line, column, is_definition. Definitions, each once however many translation units hold it."""
    return rows.where("is_definition").dropDuplicates(["fn", "file", "line", "column"])


def in_segment(calls: DataFrame, segments: DataFrame) -> DataFrame:
    """calls: trace, event_index, ... segments: trace, segment, start, stop. Calls with the segments that hold them, both ends included."""
    return calls.join(segments, "trace").where("event_index between start and stop").select(*calls.columns, "segment")


def argument_values(calls: DataFrame, callee: str, places: int = 3) -> DataFrame:
    """calls: fn, callee, args. fn, pos, value: the distinct arguments at the first places of calls to callee."""
    arg = calls.where(F.col("callee") == callee).select("fn", F.posexplode(F.slice("args", 1, places)).alias("pos", "value"))
    return arg.select("fn", F.col("pos").cast("long").alias("pos"), "value").where("value is not null").distinct()


def address_taken(assignments: DataFrame, functions: DataFrame) -> DataFrame:
    """assignments: assigned, takes_address. name: the known functions whose address is taken."""
    return assignments.where("takes_address").select(F.col("assigned").alias("name")).join(functions.select("name"), "name", "left_semi").distinct()


def run_counts(runs: DataFrame) -> DataFrame:
    """runs: entrypoint, ... entrypoint, n, label: the number of runs, named where there is more than one."""
    out = runs.where("entrypoint is not null").groupBy("entrypoint").agg(F.count("*").alias("n"))
    return out.withColumn("label", F.when(F.col("n") > 1, F.concat("entrypoint", F.lit(" ("), "n", F.lit(" runs)"))).otherwise(F.col("entrypoint")))


def root_order(runs: DataFrame) -> DataFrame:
    """runs: entrypoint, place. entrypoint, first: roots by their first appearance."""
    return runs.where("entrypoint is not null").groupBy("entrypoint").agg(F.min("place").alias("first"))


def run_totals(events: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: events, contexts, plain events, paths kept. events: trace, kind. kept: trace."""
    counts = events.agg(F.count("*").alias("events"), F.countDistinct("trace").alias("contexts"), F.count_if(F.col("kind") == "Plain").alias("plain_events"))
    return counts.crossJoin(kept.agg(F.count("*").alias("paths_kept")))  # one row each


def matching_tree(tree: DataFrame, text: str | None = None, taken: bool | None = None) -> DataFrame:
    """tree: root, path, taken. The nodes whose name holds the text, whatever its case, and whose state is taken, with all nodes above them; roots stay."""
    name, found = F.lower(F.element_at(F.split("path", "/"), -1)), F.lit(True)
    if text:
        found = found & F.contains(name, F.lit(text.lower()))
    if taken is not None:
        found = found & (F.col("taken") == taken)
    parts = F.split("path", "/")
    above = tree.where(found).select("root", F.explode(F.expr("transform(sequence(1, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("path")).distinct()
    return tree.join(above.withColumn("fw_met", F.lit(True)), ["root", "path"], "left").where(F.coalesce("fw_met", F.size(parts) == 1)).select(*tree.columns)


def appended(facts: DataFrame, more: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Ordered unique append: keys, pos, value of both in order, the first of equal values kept and places closed up. Both have pos."""
    both = facts.select(*keys, "pos", value, F.lit(0).alias("side")).unionByName(more.select(*keys, "pos", value, F.lit(1).alias("side")))
    first = both.groupBy(*keys, value).agg(F.min(F.struct("side", "pos")).alias("at"))
    return first.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("at", value)) - 1).cast("long").alias("pos"), value)


def with_globals(local: DataFrame, globals_: DataFrame, functions: DataFrame, most: int = 10_000) -> DataFrame:
    """local: fn, pos, lhs, rhs. globals_: pos, lhs, rhs, at most `most`. Every function's facts, the global ones in front, numbered anew."""
    if globals_.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} global facts, of which every function would get a copy")
    given = globals_.select("pos", "lhs", "rhs").collect()  # a checked number of rows
    every = functions.select(F.col("name").alias("fn")).distinct()
    rows = F.array(*(F.struct(F.lit(r["pos"]).cast("long").alias("pos"), F.lit(r["lhs"]).cast("string").alias("lhs"), F.lit(r["rhs"]).cast("string").alias("rhs")) for r in given))
    first = every.select("fn", F.inline(rows)) if given else local.select("fn", "pos", "lhs", "rhs").limit(0)
    both = first.withColumn("side", F.lit(0)).unionByName(local.select("fn", F.col("pos").cast("long").alias("pos"), "lhs", "rhs").withColumn("side", F.lit(1)))
    return both.select("fn", (F.row_number().over(Window.partitionBy("fn").orderBy("side", "pos", "lhs", "rhs")) - 1).cast("long").alias("pos"), "lhs", "rhs")


def path_of_rank(path: str, rank: int, kept: int) -> str:
    """The path with .rank<n> in front of its extension, where more than one path is kept."""
    head, slash, name = path.rpartition("/")
    stem, dot, extension = name.rpartition(".")
    if kept <= 1:
        return path
    return f"{head}{slash}{stem}.rank{rank}.{extension}" if dot and stem else f"{head}{slash}{name}.rank{rank}"
