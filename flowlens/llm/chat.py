"""Chat formatting from every participant's perspective, with loss masks.

For each participant the dialogue is rendered with that speaker as the assistant and the others as named users; the masks
are the code points [start, end) of the assistant's turns, end mark included. System turns stay system turns and are no
perspective. Everything is DataFrame functions.

A dialogue is rendered in parts of TURNS turns: parts in their order give the whole text, and masks count from the start of
their part. Where more rows than MAX_ROWS fall in one part (many rows of one turn), `rotate` cuts it into ranges of its order,
told apart by sub, whose masks count from the start of the range; `op5` joins the ranges again, so a part is one row whatever
its size.

Defined results: a row without conv_id belongs to no dialogue and gives nothing; null text counts as empty, a null role as
the system; null turns come first, in part -1 (`op5`: in a part of their own, null); rows alike in all four columns count
once; rows of the same turn are ordered by role and text; marks inside a text are broken up ("<|" becomes "< |"); a dialogue with system turns alone gives nothing;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import table

TURNS = 64
MAX_ROWS = 4096
SYSTEM = "system"
END = "<|end|>\n"


def _placed(rows: DataFrame, turns: DataFrame, max_rows: int) -> DataFrame:
    """rows with sub: 0, or in a crowded part the place of a range of (turn, role, text), all ranges of about max_rows rows."""
    part = turns.where("conv_id is not null").groupBy("conv_id", "part").count().where(F.col("count") > max_rows)
    ranges = part.agg(F.sum(F.ceil(F.col("count") / max_rows)).cast("long")).first()[0]
    if not ranges:
        return rows.withColumn("sub", F.lit(0).cast("long"))
    crowded = F.broadcast(part.select(F.col("conv_id").alias("c"), F.col("part").alias("p")))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p"))
    # ranges are cut in the order of the rows, on the first characters of text, so that their sample stays small
    hot = rows.join(crowded, same, "left_semi").repartitionByRange(int(ranges), "conv_id", "part", "turn", "role", F.substring("text", 1, 256))
    return rows.join(crowded, same, "left_anti").withColumn("sub", F.lit(0).cast("long")).unionByName(hot.withColumn("sub", F.spark_partition_id().cast("long")))


def rotate(turns: DataFrame, span: int = TURNS, max_rows: int = MAX_ROWS, null_part: int | None = -1) -> DataFrame:
    """turns: conv_id, turn, role, text. Returns conv_id, speaker, part, sub, n_turns, text, masks (array of s, e). null_part: the part of null turns."""
    place = F.coalesce(F.floor(F.col("turn").cast("long") / span), F.lit(null_part)).cast("long").alias("part")
    rows = turns.where("conv_id is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(SYSTEM)).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"), place,
    ).distinct()
    rows = _placed(rows, turns.select("conv_id", place), max_rows)
    speakers = rows.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    told = rows.join(speakers, "conv_id").groupBy("conv_id", "speaker", "part", "sub").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    told = told.withColumn("said", F.expr(f"""transform(t, x -> named_struct('own', x.role = speaker, 'head',
        case when x.role = speaker then '<|assistant|>\\n' when x.role = '{SYSTEM}' then '<|system|>\\n' else concat('<|user|>\\n', x.role, ': ') end, 'body', concat(x.text, '{END.replace(chr(10), chr(92) + "n")}')))"""))  # fmt: skip
    return told.select(
        "conv_id", "speaker", "part", "sub", F.size("t").cast("long").alias("n_turns"),
        F.expr("array_join(transform(said, x -> concat(x.head, x.body)), '')").alias("text"),
        F.expr("""aggregate(said, named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int>>)), (a, x) -> named_struct(
            'at', a.at + length(x.head) + length(x.body),
            'out', case when x.own then concat(a.out, array(named_struct('s', a.at + length(x.head), 'e', a.at + length(x.head) + length(x.body)))) else a.out end), a -> a.out)""").alias("masks"),
    )


def joined(pieces: DataFrame) -> DataFrame:
    """Pieces of `rotate` put together: one row for each conv_id, speaker, part, with masks that count from the start of the part."""
    whole = pieces.groupBy("conv_id", "speaker", "part").agg(F.array_sort(F.collect_list(F.struct("sub", "n_turns", "text", "masks"))).alias("t"))
    moved = "concat(a.out, transform(x.masks, m -> named_struct('s', a.at + m.s, 'e', a.at + m.e)))"
    return whole.select(
        "conv_id", "speaker", "part", F.expr("aggregate(t, 0L, (a, x) -> a + x.n_turns)").alias("n_turns"), F.expr("array_join(transform(t, x -> x.text), '')").alias("text"),
        F.expr(f"aggregate(t, named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int>>)), (a, x) -> named_struct('at', a.at + length(x.text), 'out', {moved}), a -> a.out)").alias("masks"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    out = joined(rotate(table(spark, sf_dir, "conversations"), null_part=None))
    return out.withColumn("masks", F.expr("array_join(transform(masks, x -> concat(x.s, ':', x.e)), ',')"))


OP5_SQL = r"""
WITH r AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'system') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
p AS (
  SELECT conv_id, speaker, turn, role, text, CAST(floor(turn / 64) AS BIGINT) AS part, role = speaker AS own,
    CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10) ELSE '<|user|>' || chr(10) || role || ': ' END AS head,
    text || '<|end|>' || chr(10) AS body
  FROM r JOIN s USING (conv_id)),
q AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM p)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn, role, text) AS text,
  coalesce(string_agg(CAST(CAST(upto - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (WHERE own), '') AS masks
FROM q GROUP BY conv_id, speaker, part
"""
