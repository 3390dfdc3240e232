"""Context runs of execution logs: nested sessions between entry and exit markers.

The log is a relation trace, event_index, kind (Entry, Exit, Plain), base_name. One fold in order of the events keeps the
stack of open runs; it streams over partitions that hold whole traces, sorted, and holds only the open runs of one trace, so
a long trace costs time in its task but no memory. All else is windows and aggregates over its rows.

An Exit closes runs down to the one of its name; where none has it, all are closed and the Exit belongs to no run. A Plain
event belongs to the innermost open run of its own name, else to the innermost open run.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOLD = "trace long, event_index long, what string, run_start long, parent_start long, forced boolean"

#: The callee that stands for calls whose target is unknown.
INDIRECT = "<indirect-call>"


def _fold(batches):
    """Rows 'own' (an event and the start of its run) and 'close' (the event that ends a run; forced if it isn't its exit)."""
    trace, stack, last = None, [], 0  # stack: [start, name, last own index]
    for batch in batches:
        out = []

        def close_all(at):
            while stack:
                start, _, own = stack.pop()
                out.append((trace, max(at, own), "close", start, None, True))

        for t, i, kind, name in zip(batch["trace"].tolist(), batch["event_index"].tolist(), batch["kind"].tolist(), batch["base_name"].tolist()):
            if t != trace:
                close_all(last)
                trace = t
            last = i
            if kind == "Entry":
                out.append((t, i, "own", i, stack[-1][0] if stack else None, False))
                stack.append([i, name, i])
            elif kind == "Exit":
                while stack:
                    start, own_name, _ = stack.pop()
                    out.append((t, i, "close", start, None, own_name != name))
                    if own_name == name:
                        out.append((t, i, "own", start, None, False))
                        break
            elif stack:
                run = next((r for r in reversed(stack) if r[1] == name), stack[-1])
                run[2] = i
                out.append((t, i, "own", run[0], None, False))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOLD.split(", ")])
    rest = [(trace, max(last, own), "close", start, None, True) for start, _, own in reversed(stack)]
    if rest:
        yield pd.DataFrame(rest, columns=[c.split()[0] for c in FOLD.split(", ")])


def fold(log: DataFrame) -> DataFrame:
    rows = log.select(F.col("trace").cast("long").alias("trace"), F.col("event_index").cast("long").alias("event_index"), "kind", "base_name").where("trace is not null and event_index is not null")
    return rows.repartition("trace").sortWithinPartitions("trace", "event_index").mapInPandas(_fold, FOLD)


def context_runs(log: DataFrame, folded: DataFrame | None = None) -> DataFrame:
    """trace, context_id (name#ordinal@start), entrypoint, ordinal, parent_start, start, end, owned, forced."""
    folded = fold(log) if folded is None else folded
    w = Window.partitionBy("trace", "base_name").orderBy("event_index")
    entry = log.where("kind = 'Entry'").select("trace", F.col("event_index").alias("run_start"), F.col("base_name").alias("entrypoint"), F.row_number().over(w).cast("long").alias("ordinal"))
    facts = folded.groupBy("trace", "run_start").agg(
        F.max(F.expr("case when what = 'close' then event_index end")).alias("end"), F.max("parent_start").alias("parent_start"),
        F.count_if(F.col("what") == "own").alias("owned"), F.max("forced").alias("forced"))
    out = entry.join(facts, ["trace", "run_start"])
    return out.select(
        "trace", F.format_string("%s#%d@%d", "entrypoint", "ordinal", "run_start").alias("context_id"), "entrypoint", "ordinal",
        "parent_start", F.col("run_start").alias("start"), "end", "owned", "forced")


def owners(log: DataFrame, folded: DataFrame | None = None) -> DataFrame:
    """trace, event_index, run_start (null for events of no run)."""
    own = (fold(log) if folded is None else folded).where("what = 'own'").select("trace", "event_index", "run_start")
    return log.select("trace", "event_index").join(own, ["trace", "event_index"], "left")


def segments(owned: DataFrame) -> DataFrame:
    """owned: trace, event_index, run_start. Maximal intervals of successive events of one run: trace, run_start, start, end."""
    w = Window.partitionBy("trace", "run_start").orderBy("event_index")
    islands = owned.where("run_start is not null").withColumn("island", F.col("event_index") - F.row_number().over(w))
    return islands.groupBy("trace", "run_start", "island").agg(F.min("event_index").alias("start"), F.max("event_index").alias("end")).drop("island")


def interrupts(owned: DataFrame, runs: DataFrame) -> DataFrame:
    """trace, run_start, event_index, kind, related: where a run's segments stop and go on again before its end, and whose event is there."""
    every = Window.partitionBy("trace").orderBy("event_index")
    marked = owned.select("trace", "event_index", "run_start", F.lag("run_start").over(every).alias("before"), F.lead("run_start").over(every).alias("after"))
    part = segments(owned).join(runs.select("trace", F.col("start").alias("run_start"), F.col("end").alias("run_end")), ["trace", "run_start"])
    first = Window.partitionBy("trace", "run_start").orderBy("start")
    part = part.withColumn("nth", F.row_number().over(first))
    stops = part.where("end < run_end").select("trace", "run_start", "end").join(marked.select("trace", F.col("event_index").alias("end"), F.col("after").alias("related")), ["trace", "end"])
    goes = part.where("nth > 1").select("trace", "run_start", "start").join(marked.select("trace", F.col("event_index").alias("start"), F.col("before").alias("related")), ["trace", "start"])
    a = stops.select("trace", "run_start", (F.col("end") + 1).alias("event_index"), F.lit("interrupt_start").alias("kind"), "related")
    return a.unionByName(goes.select("trace", "run_start", F.col("start").alias("event_index"), F.lit("interrupt_end").alias("kind"), "related"))


def lanes(log: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """trace, entrypoint, lane: listed entrypoints first, in their order, then the others as they appear."""
    ranked = F.coalesce(*[F.when(F.col("base_name") == n, F.lit(i)) for i, n in enumerate(priority or [])], F.lit(len(priority or []))) if priority else F.lit(0)
    first = log.where("kind = 'Entry'").withColumn("rank", ranked).groupBy("trace", "base_name").agg(F.min("rank").alias("rank"), F.min("event_index").alias("first"))
    return first.select("trace", F.col("base_name").alias("entrypoint"), (F.row_number().over(Window.partitionBy("trace").orderBy("rank", "first")) - 1).cast("long").alias("lane"))


def recent_history(log: DataFrame, n: int = 3) -> DataFrame:
    """trace, event_index, history: the last n plain names up to the event, joined by ' | '."""
    w = Window.partitionBy("trace").orderBy("event_index").rowsBetween(-(n - 1), 0)
    return log.where("kind = 'Plain'").select("trace", "event_index", F.array_join(F.collect_list("base_name").over(w), " | ").alias("history"))


def child_calls(runs: DataFrame, static: DataFrame) -> DataFrame:
    """Calls that parents make by entering a child run: trace, caller_start, event_index, callee. static: caller, callee.

    The child's entrypoint must have static callers; where any function calls indirectly (the callee `<indirect-call>`), every
    entrypoint may be called.
    """
    callee = static.select(F.col("callee").alias("entrypoint")).distinct()
    open_ = F.broadcast(callee.agg(F.coalesce(F.bool_or(F.col("entrypoint") == INDIRECT), F.lit(False)).alias("fw_any")))  # one row
    known = callee.where(F.col("entrypoint") != INDIRECT).withColumn("fw_known", F.lit(True))
    told = runs.where("parent_start is not null").join(known, "entrypoint", "left").join(open_, F.lit(True)).where("fw_known or fw_any")
    return told.select("trace", F.col("parent_start").alias("caller_start"), F.col("start").alias("event_index"), F.col("entrypoint").alias("callee"))
