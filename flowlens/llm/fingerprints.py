r"""Document fingerprints: one-permutation MinHash over five-word shingles, four bits a bin.

Texts are lower-cased in A-Z and cut in words `[^\x20\x09-\x0D]+`; a text of fewer than five words is one shingle. Each
shingle is hashed once: the top bits of its hash choose one of BINS bins, the rest is its value, and a bin keeps its least
value. An empty bin walks its own random order of bins to the first full one and takes its value (optimal densification). What
is stored of a bin are BITS low-order bits of its value, mixed with the bin's number so that taken values don't agree by
chance together; a fingerprint is BINS of them in hex, one digit a bin, and "" for a text without words. Two bins of different
values agree with chance 2**-BITS; `likeness` takes that share out of the part that agrees.

`op12` compares each document with the next one by doc_id. Documents are dealt to ranges of doc_id, once; the ranges begin at
doc_ids of the table, so the document that begins a range can be dealt to the range before it as well, and every document
meets the one after it in one sorted stream. Only where ranges begin comes to the driver: one doc_id for each partition.

Defined results: null text is empty; two texts without words have likeness 1, one without and one with words 0; equal texts have
equal fingerprints; rows of one doc_id follow each other by text; a single document is its own next; a row with a null doc_id
has no place in the order: its edited text is its first half alone and near_next is null; an empty table gives no rows; other
columns are ignored. Texts longer than a piece of `scan.CHUNK` bytes are hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowlens.llm import scan
from flowlens.llm.common import table

WORDS = 5
BINS = 512
BITS = 4
#: Bits of a shingle's value; with the bin and a text's place among those scanned together they fill 64.
VALUE_BITS = 45
_EMPTY = np.uint64((1 << 64) - 1)
_TOGETHER = 1 << (64 - VALUE_BITS - BINS.bit_length() + 1)
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
#: Steps that all empty bins walk together before the few that are left look at every full bin.
STEPS = 12
_walks: list[np.ndarray] = []


def _walk() -> tuple[np.ndarray, np.ndarray]:
    """The order of bins that each bin walks (a row for each), and at which step it meets each bin."""
    if not _walks:
        chance = scan.mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(0x5DEECE66D)).reshape(BINS, BINS)
        order = np.argsort(chance, axis=1, kind="stable").astype(np.int16)
        _walks[:] = [order, np.argsort(order, axis=1, kind="stable").astype(np.int16)]
    return _walks[0], _walks[1]


def _shingles(words: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words at which a shingle begins, and its hash. at: each word's place in its text; left: words from it to the text's end."""
    begin = np.flatnonzero((left >= WORDS) | (at == 0))
    out = np.zeros(len(begin), np.uint64)
    room = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        out += np.where(left[begin] > k, room[begin + k], np.uint64(0)) * np.uint64(_ODD[k])
    return begin, scan.mix(out)


def _least(key: np.ndarray, n: int) -> np.ndarray:
    """key: text, bin and value of each shingle in one number. The least value of each of the n texts' bins."""
    out = np.full(n * BINS, _EMPTY)
    key = np.sort(key)
    cell = key >> np.uint64(VALUE_BITS)
    first = np.ones(len(key), bool)
    first[1:] = cell[1:] != cell[:-1]
    out[cell[first].astype(np.int64)] = key[first] & np.uint64((1 << VALUE_BITS) - 1)
    return out.reshape(n, BINS)


def _placed(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - VALUE_BITS - BINS.bit_length() + 1)


def _bins(texts: list[bytes]) -> np.ndarray:
    """The least values of texts that take less than CHUNK bytes together, with _EMPTY for none."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    first, last = scan.word_bounds(scan.CLASSES[data], offsets)
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = np.diff(np.searchsorted(starts, offsets))
    text = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
    begin, hashes = _shingles(scan.hashes(data, starts, ends), at, n[text] - at)
    return _least(text[begin].astype(np.uint64) << np.uint64(VALUE_BITS + BINS.bit_length() - 1) | _placed(hashes), len(texts))


def _long_bins(text: bytes) -> np.ndarray:
    """The same of one longer text; the last words of a piece begin shingles that end in the next."""
    data, out, seen, held = np.frombuffer(text, np.uint8), np.full((1, BINS), _EMPTY), 0, np.zeros(0, np.uint64)
    for start, end, one_word in scan.pieces(data, scan.CHUNK):
        part = data[start:end]
        if one_word:
            words = np.array([scan.long_hash(part)])
        else:
            first, last = scan.word_bounds(scan.CLASSES[part], np.array([0, len(part)]))
            words = scan.hashes(part, np.flatnonzero(first), np.flatnonzero(last) + 1)
        seen += len(words)
        held = np.concatenate([held, words])
        left = np.arange(len(held), 0, -1)
        _, hashes = _shingles(held, np.ones(len(held), np.int64), left)
        out = np.minimum(out, _least(_placed(hashes), 1))
        held = held[-(WORDS - 1) :]
    if 0 < seen < WORDS:
        _, hashes = _shingles(held, np.arange(seen), np.arange(seen, 0, -1))
        out = _least(_placed(hashes), 1)
    return out


def _filled(least: np.ndarray) -> np.ndarray:
    """least with the empty bins of texts that have any full one filled."""
    order, rank = _walk()
    out, full = least.copy(), least != _EMPTY
    t, b = np.nonzero(~full & full.any(1)[:, None])
    for step in range(STEPS):
        met = order[b, step]
        good = full[t, met]
        out[t[good], b[good]] = least[t[good], met[good]]
        t, b = t[~good], b[~good]
    bounds = np.searchsorted(t, np.arange(len(least) + 1))
    for i in np.unique(t).tolist():
        mine, there = b[bounds[i] : bounds[i + 1]], np.flatnonzero(full[i])
        out[i, mine] = least[i, there[rank[np.ix_(mine, there)].argmin(1)]]
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """BITS bits of each bin of each text (uint8), and whether the text has words."""
    raw, least, i = [t.encode("utf-8", "surrogatepass").translate(scan.LOWER) for t in texts], [], 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and j - i < _TOGETHER and size + len(raw[j]) < scan.CHUNK:
            size, j = size + len(raw[j]), j + 1
        least.append(_bins(raw[i:j]) if j > i else _long_bins(raw[i]))
        i = max(j, i + 1)
    values = np.concatenate(least) if least else np.zeros((0, BINS), np.uint64)
    some = (values != _EMPTY).any(1)
    place = scan.mix(np.arange(1, BINS + 1, dtype=np.uint64))
    return (scan.mix(_filled(values) ^ place) & np.uint64((1 << BITS) - 1)).astype(np.uint8), some


def packed(code: np.ndarray, some: np.ndarray) -> list[str]:
    """Fingerprints in hex."""
    both = code[:, ::2] << 4 | code[:, 1::2]
    return [row.tobytes().hex() if s else "" for row, s in zip(both, some.tolist())]


def alike(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """The likeness of texts by their codes: the part of bins that agree, less what agrees by chance."""
    chance = 2.0**-BITS
    found = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, found, np.where(some_a | some_b, 0.0, 1.0))


def likeness(a: str, b: str) -> Column:
    """The same of two columns of fingerprints."""
    chance = 2.0**-BITS
    equal = f"aggregate(zip_with(split({a}, ''), split({b}, ''), (x, y) -> if(x = y and x <> '', 1, 0)), 0, (s, x) -> s + x)"
    return F.expr(f"case when {a} = '' and {b} = '' then 1D when {a} = '' or {b} = '' then 0D else greatest(0D, ({equal} / {BINS}D - {chance}D) / {1 - chance}D) end")


def fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """docs with the column to: the fingerprint of text."""

    def work(batches):
        for b in batches:
            names, columns = [n for n in b.schema.names if n != to], b.column(b.schema.get_field_index(text))
            found = packed(*codes(["" if t is None else t for t in columns.to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(found, pa.string())], names=[*names, to])

    schema = T.StructType([f for f in docs.schema if f.name != to]).add(to, "string")
    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(work, T.StructType([T.StructField(f.name, T.StringType()) if f.name == text else f for f in schema]))


#: Characters, and rows, of documents whose fingerprints are made together.
_BLOCK_CHARS, _BLOCK_ROWS = 1 << 19, 256


def _block(rows: list[tuple]) -> list[pa.Array]:
    """The columns after doc_id. rows: doc_id, text, text of the next document or None, whether that is the next of rows."""
    texts, edited = [r[1] for r in rows], []
    for _, text, after, _ in rows:
        half = len(text) // 2
        edited.append(text[: len(text) - half] + (after or "")[:half])
    others = [r[2] or "" for r in rows if not r[3]]
    code, some = codes([*texts, *edited, *others])
    n, spare = len(rows), iter(range(2 * len(rows), 2 * len(rows) + len(others)))
    following = np.array([k + 1 if r[3] else next(spare) for k, r in enumerate(rows)])
    near_next = alike(code[:n], some[:n], code[following], some[following])
    prints = packed(code[: 2 * n], some[: 2 * n])
    return [
        pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]), pa.array(prints[:n], pa.string()), pa.array(prints[n:], pa.string()),
        pa.array(alike(code[:n], some[:n], code[n : 2 * n], some[n : 2 * n])), pa.array(near_next, mask=np.array([r[2] is None for r in rows])),
    ]


def _paired(batches) -> Iterator[tuple]:
    """(doc_id, text, text of the next document or None, whether that is the row after) of rows in their order; rows dealt as a neighbour alone give none."""
    before = None
    for b in batches:
        for doc_id, text, placed, bucket, extra in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["placed"].to_pylist(), b["bucket"].to_pylist(), b["extra"].to_pylist()):
            if not placed:
                yield doc_id, text, None, False
                continue
            if before is not None and before[3] == bucket and not before[2]:
                yield before[0], before[1], text, not extra
            before = (doc_id, text, extra, bucket)


def _fingerprinted(kind: pa.DataType):
    def work(batches):
        held, size = [], 0

        def out():
            last = held[-1]
            held[-1] = (*last[:3], False)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], kind), *_block(held)], names=[f.split()[0] for f in _SCHEMA])

        for row in _paired(batches):
            held.append(row)
            size += 2 * len(row[1]) + len(row[2] or "")
            if size >= _BLOCK_CHARS or len(held) >= _BLOCK_ROWS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return work


_SCHEMA = ["doc_id", "n_chars long", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double"]


def with_next(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Rows dealt to buckets, ranges of doc_id, and sorted there; extra: a document that begins the following range (after the last: the first)."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ranges = docs.where("doc_id is not null").select("doc_id").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("low"))
    lows = sorted(r["low"] for r in ranges.collect())  # one for each partition
    kind = docs.schema["doc_id"].dataType
    begins = F.array(*(F.lit(x).cast(kind) for x in lows[1:])) if len(lows) > 1 else F.array().cast(T.ArrayType(kind))
    steps = [1 << k for k in reversed(range(max(1, len(lows)).bit_length()))]
    rows = docs.withColumn("begins", begins)
    # the number of ranges that begin at or before doc_id, by halving
    rows = rows.withColumn("bucket", F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (a, s) -> case when get(begins, a + s - 1) <= doc_id then a + s else a end)"))
    own = "case when doc_id is null then struct(pmod(spark_partition_id(), {n}) as bucket, false as extra, false as placed) else struct(bucket, false as extra, true as placed) end".format(n=n)
    before = "case when get(begins, bucket - 1) = doc_id then struct(bucket - 1 as bucket, true as extra, true as placed) end"
    around = f"case when doc_id = low then struct({max(0, len(lows) - 1)} as bucket, true as extra, true as placed) end"
    rows = rows.withColumn("low", F.lit(lows[0] if lows else None).cast(kind)).select("doc_id", "text", F.explode(F.expr(f"array_compact(array({own}, {before}, {around}))")).alias("at"))
    rows = rows.select("doc_id", "text", "at.bucket", "at.extra", "at.placed").repartitionById(n, F.col("bucket"))
    return rows.sortWithinPartitions("placed", "bucket", "extra", "doc_id", "text")


def edited(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. The columns of op12's contract."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)])
    for f in _SCHEMA[1:]:
        schema = schema.add(*f.split())
    return with_next(rows).mapInArrow(_fingerprinted(to_arrow_type(kind)), schema)


def op12(spark, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
