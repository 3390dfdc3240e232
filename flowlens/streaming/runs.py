"""Context runs of logs that are still being written.

The state of a trace is its stack of open runs and the last event seen. Events of one trace must arrive in order from one
micro-batch to the next; within a micro-batch they are sorted, so a trace's share of it must fit a task (set
maxFilesPerTrigger or the like). An event that isn't above the last one seen is late and ignored. Runs are given out when
they close; those still open stay in the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUNS = "trace long, entrypoint string, start long, parent_start long, end long, owned long, forced boolean"
_STATE = "starts array<long>, names array<string>, owned array<long>, last long"


def _close(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    starts, names, owned, last = state.get if state.exists else ([], [], [], -1)
    stack = [list(x) for x in zip(starts, names, owned)]
    out = []

    def pop(end: int, forced: bool) -> None:
        start, name, n = stack.pop()
        out.append((key[0], name, start, stack[-1][0] if stack else None, end, n, forced))

    events = pd.concat(list(batches)).sort_values("event_index")
    for i, kind, name in zip(events["event_index"].tolist(), events["kind"].tolist(), events["base_name"].tolist()):
        if i <= last:
            continue
        last = i
        if kind == "Entry":
            stack.append([i, name, 1])
        elif kind == "Exit":
            while stack:
                own = stack[-1][1] == name
                stack[-1][2] += own
                pop(i, not own)
                if own:
                    break
        elif stack:
            next((r for r in reversed(stack) if r[1] == name), stack[-1])[2] += 1
    state.update(([x[0] for x in stack], [x[1] for x in stack], [x[2] for x in stack], last))
    columns = [c.split()[0] for c in RUNS.split(", ")]
    yield pd.DataFrame(out, columns=columns).astype({"parent_start": "Int64"})


def closed_runs(stream: DataFrame) -> DataFrame:
    """stream: trace, event_index, kind, base_name. A row for each run that closes; output mode append."""
    rows = stream.select(F.col("trace").cast("long").alias("trace"), F.col("event_index").cast("long").alias("event_index"), "kind", "base_name").where("trace is not null and event_index is not null")
    return rows.groupBy("trace").applyInPandasWithState(_close, RUNS, _STATE, "append", GroupStateTimeout.NoTimeout)


def plain_counts(stream: DataFrame, late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Plain events by name and time window; later ones than the watermark are left out. stream: ts, kind, base_name."""
    return stream.withWatermark("ts", late).where("kind = 'Plain'").groupBy(F.window("ts", span), "base_name").agg(F.count("*").alias("n"))
