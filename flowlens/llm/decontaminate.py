"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Text is normalised bytewise (A-Z lowered, every ASCII byte that is no letter or digit becomes a separator) and its words
are joined by single spaces, so an automaton over `" w1 .. wk "` finds whole windows in one scan. Offsets of hits lead back
to words and from there to code points of the original text.

The benchmark is the stated query set: it is read in blocks of at most BLOCK_BYTES of window text, one automaton each,
which a worker builds once for all of its tasks. The documents pass through the blocks one after the other, without a
shuffle; what a block leaves is written before the next one, so one automaton is held at a time.

Defined results: null or wordless text has no words and no hits; items without words have no windows; repeated items,
repeated documents and null ids are kept as they are (a null item_id takes part under the name "null"); an empty benchmark
gives no hits; other columns of the documents are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import staged, table

WINDOW = 10
#: Bound on the window text of one automaton, which every Python worker holds: 4 MB of it were measured to take 174 MB there.
BLOCK_BYTES = 8 << 20

_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows_of(text: str | None, size: int) -> set[tuple[bytes, int]]:
    """(pattern, number of its words) for each window of a benchmark text."""
    words = words_of(text)
    if not words:
        return set()
    k = min(size, len(words))
    return {(b" " + b" ".join(words[i : i + k]) + b" ", k) for i in range(len(words) - k + 1)}


def blocks_of(rows: Iterable, size: int, limit: int) -> Iterator[dict[bytes, tuple[int, list[str]]]]:
    """Benchmark rows as blocks: pattern -> (words, item ids), each block of at most limit bytes (or one item)."""
    block: dict[bytes, tuple[int, list[str]]] = {}
    held = 0
    for item_id, text in rows:
        found = windows_of(text, size)
        more = sum(len(p) for p, _ in found)
        if block and held + more > limit:
            yield block
            block, held = {}, 0
        held += more
        for pattern, k in found:
            ids = block.setdefault(pattern, (k, []))[1]
            if (name := "null" if item_id is None else str(item_id)) not in ids:
                ids.append(name)
    if block:
        yield block


def automaton_of(block: dict[bytes, tuple[int, list[str]]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern, value in block.items():
        found.add_word(pattern.decode("latin-1"), value)
    found.make_automaton()
    return found


_held: dict[str, object] = {}


def held_automaton(key: str, block):
    """The automaton of a broadcast block, built once in a worker; it replaces the one of another block."""
    if key not in _held:
        _held.clear()
        _held[key] = automaton_of(block.value)
    return _held[key]


def hits_in(automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word intervals (first, last) that windows cover, and the items they come from."""
    if not words:
        return [], set()
    scanned = b" " + b" ".join(words) + b" "
    raw = list(automaton.iter(scanned.decode("latin-1")))
    if not raw:
        return [], set()
    ends, at = {}, 0
    for i, w in enumerate(words):
        at += len(w) + 1
        ends[at] = i
    spans, items = [], set()
    for end, (k, ids) in raw:
        spans.append((ends[end] - k + 1, ends[end]))
        items.update(ids)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, items


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*map(tuple, a), *b]):
        if out and x <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word intervals as code points [start, end) of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b][1]) for a, b in spans]


_KEEP = "array<struct<a:int,b:int>>"


def _scanner(block, carry: bool):
    """block: a broadcast block, or None for the empty one. carry: the text is needed once more."""
    key = uuid.uuid4().hex

    def scan(batches):
        automaton = held_automaton(key, block) if block is not None else None
        for batch in batches:
            spans, items, counts, chars = [], [], [], []
            for text, old, names in zip(batch["text"].to_pylist(), batch["hit_words"].to_pylist(), batch["items"].to_pylist()):
                words = words_of(text)
                new, found = hits_in(automaton, words) if automaton else ([], set())
                both = merge([(x["a"], x["b"]) for x in old or ()], new)
                counts.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in both])
                chars.append([{"a": a, "b": b} for a, b in char_spans(text, both)] if both else [])
                items.append(sorted({*(names or ()), *found}))
            pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text"] if carry else pa.nulls(len(counts), pa.string()), pa.array(counts, pa.int64()), pa.array(spans, pair), pa.array(items, pa.list_(pa.string())), pa.array(chars, pair)],
                names=["doc_id", "text", "n_words", "hit_words", "items", "hit_chars"],
            )

    return scan


def find_overlaps(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hit_words (word intervals, both ends included), items (sorted ids), hit_chars ([start, end) code points)."""
    spark = docs.sparkSession
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = out.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_words bigint, hit_words {_KEEP}, items array<string>, hit_chars {_KEEP}"
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator(prefetchPartitions=False)
    out = out.withColumns({"hit_words": F.lit(None).cast(_KEEP), "items": F.lit(None).cast("array<string>")})
    todo = blocks_of(rows, size, block_bytes)
    block = next(todo, None)
    while True:
        after = next(todo, None)
        held = spark.sparkContext.broadcast(block) if block else None
        out = out.select("doc_id", "text", "hit_words", "items").mapInArrow(_scanner(held, after is not None), schema)
        if after is None:
            return out.drop("text")
        out, block = staged(out), after


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    n_hit = F.aggregate("hit_words", F.lit(0).cast("bigint"), lambda n, x: n + (x["b"] - x["a"] + 1).cast("bigint"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without a hit word. All columns stay, and so do rows of null text; nothing is shuffled."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator(prefetchPartitions=False)

    def dropper(block):
        key = uuid.uuid4().hex

        def clean(batches):
            automaton = held_automaton(key, block)
            for batch in batches:
                yield batch.filter(pa.array([not hits_in(automaton, words_of(t))[0] for t in batch["text"].to_pylist()], pa.bool_()))

        return clean

    for i, block in enumerate(blocks_of(rows, size, block_bytes)):
        docs = (staged(docs) if i else docs).mapInArrow(dropper(spark.sparkContext.broadcast(block)), docs.schema)
    return docs


def op4(spark, sf_dir: str) -> DataFrame:
    return digest(find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
    SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(hi.items, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
