"""Pattern matches with offsets, as SQL expressions: leftmost, not overlapping, in code points, end exclusive.

Spark's regexp_extract_all gives the matches and split with the same pattern gives the text between them; their lengths
give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,s:int,e:int,m:string>>"


def propose(df: DataFrame, text: str, kind: str, pattern: str, keep: str, guard: str = "true") -> DataFrame:
    """df with the column fw_<kind>: spans of the matches m that satisfy keep (SQL over m). guard: SQL over the text without which there is no match."""
    hits, good, gaps = f"fw_{kind}_m", f"fw_{kind}_k", f"fw_{kind}_g"
    df = df.withColumn(hits, F.expr(f"case when {guard} then regexp_extract_all({text}, r'{pattern}', 0) end"))
    df = df.withColumn(good, F.expr(f"transform({hits}, m -> {keep})"))
    df = df.withColumn(gaps, F.expr(f"case when array_contains({good}, true) then transform(split({text}, r'{pattern}', -1), x -> length(x)) end"))
    walk = f"""coalesce(aggregate(case when {gaps} is not null then sequence(0, size({hits}) - 1) end,
        named_struct('at', 0, 'out', cast(array() as {SPAN})),
        (a, i) -> named_struct(
            'at', a.at + get({gaps}, i) + length(get({hits}, i)),
            'out', case when get({good}, i) then concat(a.out, array(named_struct('kind', '{kind}', 's', a.at + get({gaps}, i),
                'e', a.at + get({gaps}, i) + length(get({hits}, i)), 'm', get({hits}, i)))) else a.out end),
        a -> a.out), cast(array() as {SPAN}))"""
    return df.withColumn(f"fw_{kind}", F.expr(walk)).drop(hits, good, gaps)


def ordered(kinds: list[str], spans: str) -> Column:
    """The spans by start, then by the order of kinds, as `kind:start:end` joined by commas."""
    rank = "array_position(array({}), x.kind)".format(", ".join(f"'{k}'" for k in kinds))
    return F.expr(f"array_join(transform(array_sort(transform({spans}, x -> named_struct('s', x.s, 'r', {rank}, 'e', x.e, 'k', x.kind))), x -> concat_ws(':', x.k, x.s, x.e)), ',')")


def apart(spans: str, others: str) -> str:
    """SQL: the spans that overlap none of others."""
    return f"filter({spans}, x -> not exists({others}, y -> x.s < y.e and y.s < x.e))"


def masked(text: str, spans: str, label: str) -> Column:
    """The text with each span (overlapping ones as one) replaced by label."""
    merged = f"""aggregate(array_sort(transform({spans}, x -> named_struct('s', x.s, 'e', x.e))),
        named_struct('at', 0, 'out', ''),
        (a, x) -> case when x.s < a.at then named_struct('at', greatest(a.at, x.e), 'out', concat(a.out, substring({text}, 1, 0)))
                       else named_struct('at', x.e, 'out', concat(a.out, substring({text}, a.at + 1, x.s - a.at), '{label}')) end,
        a -> concat(a.out, substring({text}, a.at + 1)))"""
    return F.expr(f"case when size({spans}) = 0 then {text} else {merged} end")
