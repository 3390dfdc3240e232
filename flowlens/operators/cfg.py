"""Control-flow graphs as relations: blocks(fn, block, succ), calls(fn, block, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.loops import MAX_ROUNDS, Rounds, grow, improved, staged


def predecessors(blocks: DataFrame) -> DataFrame:
    return blocks.where("succ is not null").select("fn", F.col("succ").alias("block"), F.col("block").alias("pred")).distinct()


def linear_functions(blocks: DataFrame) -> DataFrame:
    """fn, linear: no block has more than one successor or predecessor."""
    edge = blocks.where("succ is not null").select("fn", "block", "succ").distinct()
    ends = edge.select("fn", F.explode(F.array(F.struct(F.lit("o").alias("way"), F.col("block").alias("b")), F.struct(F.lit("i").alias("way"), F.col("succ").alias("b")))).alias("x"))
    widest = ends.groupBy("fn", "x").count().groupBy("fn").agg(F.max("count").alias("most"))
    return blocks.select("fn").distinct().join(widest, "fn", "left").select("fn", F.coalesce(F.col("most") <= 1, F.lit(True)).alias("linear"))


def epsilon_closure(blocks: DataFrame, calls: DataFrame) -> DataFrame:
    """fn, block, reached: the blocks that are reached from a block without a call; the first block with calls on a way is the last of it."""
    edge = staged(blocks.where("succ is not null").select("fn", F.col("block").alias("reached"), F.col("succ").alias("next")).distinct())
    busy = calls.select("fn", F.col("block").alias("reached")).distinct()
    free = staged(edge.join(busy, ["fn", "reached"], "left_anti"))
    first = blocks.select("fn", "block", F.col("block").alias("reached")).distinct()
    return grow(first, lambda new: new.join(free, ["fn", "reached"]).select("fn", "block", F.col("next").alias("reached")))


def min_calls_to_exit(blocks: DataFrame, calls: DataFrame, exits: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """calls: fn, block, n. exits: fn, block. fn, block, least number of calls from the start of the block to the exit; null where it can't be reached."""
    edge = staged(blocks.where("succ is not null").select("fn", "block", "succ").distinct())
    weight = blocks.select("fn", "block").distinct().join(calls, ["fn", "block"], "left").select("fn", "block", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    weight = staged(weight)
    best = Rounds(weight.join(exits, ["fn", "block"], "left_semi").select("fn", "block", F.col("n").alias("least")))
    for _ in range(max_rounds):
        sent = edge.join(best.newest.select("fn", F.col("block").alias("succ"), "least"), ["fn", "succ"]).join(weight, ["fn", "block"])
        sent = sent.groupBy("fn", "block").agg(F.min(F.col("least") + F.col("n")).alias("least"))
        if not best.add(improved(sent, best.all, ["fn", "block"], "least", unknown=True)).take(1):
            found = best.all.groupBy("fn", "block").agg(F.min("least").alias("min_calls"))
            return weight.select("fn", "block").join(found, ["fn", "block"], "left")
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")


def collapse_passthrough(blocks: DataFrame, empty: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """empty: fn, block without lines. Blocks that are empty and have one successor vanish and their predecessors go on to
    what follows: pointer jumping, so long chains take log rounds. A cycle of empty blocks stays. Returns fn, block, succ."""
    edge = blocks.select("fn", "block", "succ").distinct()
    single = edge.where("succ is not null").groupBy("fn", "block").agg(F.count("*").alias("k"), F.min("succ").alias("to")).where("k = 1 and to <> block")
    hop = staged(single.join(empty, ["fn", "block"], "left_semi").select("fn", "block", "to"))
    for _ in range(max_rounds):
        after = hop.select("fn", F.col("block").alias("to"), F.col("to").alias("then"))
        both = staged(hop.join(after, ["fn", "to"], "left").select("fn", "block", "to", F.when(F.col("then") != F.col("block"), F.col("then")).alias("then")))
        hop = both.select("fn", "block", F.coalesce("then", "to").alias("to"))
        if not both.where("then is not null").take(1):
            break
    gone = hop.select("fn", "block", "to")
    kept = edge.join(gone.select("fn", "block"), ["fn", "block"], "left_anti")
    moved = kept.join(gone.select("fn", F.col("block").alias("succ"), "to"), ["fn", "succ"], "left")
    return moved.select("fn", "block", F.coalesce("to", "succ").alias("succ")).distinct()


def ordered_callees(calls: DataFrame) -> DataFrame:
    """calls: fn, block, line_pos, call_pos, site, callee. The callees of each block in order, each call site once, at its first place."""
    first = calls.groupBy("fn", "block", "site").agg(F.min(F.struct("line_pos", "call_pos", "callee")).alias("x"))
    out = first.groupBy("fn", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return out.select("fn", "block", F.expr("array_join(transform(xs, x -> x.callee), ',')").alias("callees"))


def unique_base(definitions: DataFrame) -> DataFrame:
    """definitions: fn, pointer, base (null where it is no global). Pointers whose every definition has the same base: fn, pointer, base."""
    one = definitions.groupBy("fn", "pointer").agg(F.min("base").alias("base"), F.max("base").alias("other"), F.count_if(F.col("base").isNull()).alias("none"))
    return one.where("none = 0 and base = other").select("fn", "pointer", "base")


def global_pointers(definitions: DataFrame, names: DataFrame, marked: DataFrame | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """definitions: fn, pointer, rhs. names: name of file-scope variables. fn, pointer, base: pointers all of whose definitions lead to the same global.

    A right side counts by its first identifier: a global, or a pointer of the function that is one of these in turn. A single
    definition that leads elsewhere, to another global or to itself keeps a pointer out, and with it those that depend on it; so
    pointers that define each other in a cycle stay out. Each round settles the definitions by what was resolved in the last
    one, and looks only at the pointers that these belong to.

    marked: fn, name of what some assignment marks as global; where its definitions don't decide it, it is its own base.
    """
    first = F.regexp_extract("rhs", r"[A-Za-z_]\w*", 0)
    rule = staged(definitions.where("pointer is not null").select("fn", "pointer", F.coalesce(first, F.lit("")).alias("src")).distinct())
    globals_ = names.select(F.col("name").alias("src")).distinct()
    open_ = staged(rule.join(globals_, "src", "left_anti"))
    total = staged(rule.groupBy("fn", "pointer").agg(F.count("*").alias("total")))
    settled = Rounds(rule.join(globals_, "src", "left_semi").select("fn", "pointer", "src", F.col("src").alias("base")))
    resolved = None
    for _ in range(max_rounds):
        touched = settled.newest.select("fn", "pointer").distinct()
        told = settled.all.join(touched, ["fn", "pointer"], "left_semi").groupBy("fn", "pointer").agg(F.count("*").alias("n"), F.min("base").alias("base"), F.max("base").alias("other"))
        found = told.join(total, ["fn", "pointer"]).where("n = total and base = other").select("fn", "pointer", "base")
        if resolved is None:
            resolved = Rounds(found)
        else:
            resolved.add(found)
        if not resolved.newest.take(1):
            if marked is None:
                return resolved.all
            own = marked.select("fn", F.col("name").alias("pointer"), F.col("name").alias("base")).distinct().join(resolved.all, ["fn", "pointer"], "left_anti")
            resolved.add(own.join(globals_.withColumnRenamed("src", "pointer"), "pointer", "left_anti").select("fn", "pointer", "base"))
            marked = None
        settled.add(open_.join(resolved.newest.select("fn", F.col("pointer").alias("src"), "base"), ["fn", "src"]).select("fn", "pointer", "src", "base"))
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
