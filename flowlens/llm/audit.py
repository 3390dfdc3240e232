r"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Failures, over the words `[^\x20\x09-\x0D]+` of the whole text (case-sensitive): A under 50 words; B 100 * distinct words <
65 * words; C 100 * `[A-Z]` characters > 5 * code points; D holds any of `#$%&*|`; E identical to the text of any smaller
doc_id in the table.

A to D come from one scan of the Arrow buffers: byte classes by a lookup table, prefix sums for words, capitals, symbols and
code points of each text, and the sorted word hashes of each text for its distinct words. Words of one hash are compared byte
by byte, and where two differ the text's words are counted as they are. Long texts are scanned piece by piece.

Only (doc_id, part, digest of the text, failures) leaves the scan. Equal texts fail A to D alike, so E is decided on counts: rows
are summed by digest, part and label before the smallest doc_id of a digest is joined to them, and a text that a third of all
rows share is at most four rows a part there. The result follows from at most 32 counts for each part.

Defined results: null text is empty and null source the part ''; empty texts are identical to each other; rows with a null doc_id
have no label, are never removed by E and are no smaller doc_id; rows that repeat a doc_id and a text count each, and none of
them is smaller than the other; a document is good or toxic if any of its labels says so; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import scan
from flowlens.llm.common import table

MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Bits of a word hash that are sorted by; fewer give the same results, by more comparisons. The other bits hold the text's place.
HASH_BITS = 52


def _distinct(data: np.ndarray, key: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one word for each key, and the keys under which different words stand."""
    order = np.argsort(key)
    k, s, z = key[order], starts[order], sizes[order]
    same = np.flatnonzero(k[1:] == k[:-1])
    clash = z[same] != z[same + 1]
    clash[~clash] = scan.differ(data, s[same][~clash], s[same + 1][~clash], z[same][~clash])
    new = np.ones(len(k), bool)
    new[same + 1] = False
    return order[new], k[same[clash]]


def _measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows words, capitals, symbols, code points, distinct words, of texts that take up to CHUNK bytes together."""
    kinds = scan.CLASSES[data]
    first, last = scan.word_bounds(kinds, offsets)
    out = np.zeros((5, len(offsets) - 1), np.int64)
    for row, flags in enumerate((first, kinds & scan.CAPITAL != 0, kinds & scan.SYMBOL != 0, kinds & scan.FOLLOWS == 0)):
        sums = np.concatenate([[0], np.cumsum(flags)])
        out[row] = sums[offsets[1:]] - sums[offsets[:-1]]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), out[0])
    key = (text << np.uint64(HASH_BITS)) | (scan.hashes(data, starts, ends) & np.uint64((1 << HASH_BITS) - 1))
    one, clash = _distinct(data, key, starts, ends - starts)
    out[4] = np.bincount(text[one].astype(np.int64), minlength=out.shape[1])
    for t in np.unique(clash >> np.uint64(HASH_BITS)).astype(int).tolist():
        raw, mine = data.tobytes(), text == t
        out[4, t] = len({raw[s:e] for s, e in zip(starts[mine].tolist(), ends[mine].tolist())})
    return out


def _long_measures(data: np.ndarray) -> np.ndarray:
    """The same of one longer text, piece by piece: each piece leaves one place for each distinct word."""
    out, keys, places, sizes, clashes = np.zeros(5, np.int64), [], [], [], False
    bits = np.uint64((1 << HASH_BITS) - 1)
    for start, end, one_word in scan.pieces(data, scan.CHUNK):
        if one_word:
            for at in range(start, end, scan.CHUNK):
                kinds = scan.CLASSES[data[at : min(end, at + scan.CHUNK)]]
                out[1:4] += [(kinds & scan.CAPITAL != 0).sum(), (kinds & scan.SYMBOL != 0).sum(), (kinds & scan.FOLLOWS == 0).sum()]
            out[0] += 1
            s, e, key = np.array([0]), np.array([end - start]), np.array([scan.long_hash(data[start:end])]) & bits
            part, kept = data[start:end], np.array([0])
        else:
            part = data[start:end]
            kinds = scan.CLASSES[part]
            first, last = scan.word_bounds(kinds, np.array([0, len(part)]))
            out[:4] += [first.sum(), (kinds & scan.CAPITAL != 0).sum(), (kinds & scan.SYMBOL != 0).sum(), (kinds & scan.FOLLOWS == 0).sum()]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            key = scan.hashes(part, s, e) & bits
            kept, clash = _distinct(part, key, s, e - s)
            clashes = clashes or len(clash) > 0
        keys.append(key[kept])
        places.append(s[kept] + start)
        sizes.append((e - s)[kept])
    if not clashes:
        s, z = np.concatenate(places), np.concatenate(sizes)
        one, clash = _distinct(data, np.concatenate(keys), s, z)
        out[4], clashes = len(one), len(clash) > 0
    if clashes:
        out[4] = len({data[s + a : s + b].tobytes() for s, e, _ in scan.pieces(data, scan.CHUNK) for a, b in _words(data[s:e])})
    return out


def _words(part: np.ndarray) -> list[tuple[int, int]]:
    first, last = scan.word_bounds(scan.CLASSES[part], np.array([0, len(part)]))
    return list(zip(np.flatnonzero(first).tolist(), (np.flatnonzero(last) + 1).tolist()))


def measures(texts: pa.Array) -> np.ndarray:
    """Rows words, capitals, symbols, code points, distinct words; a column for each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, raw = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out, i, n = np.zeros((5, len(texts)), np.int64), 0, len(texts)
    while i < n:
        j = min(int(np.searchsorted(offsets, offsets[i] + scan.CHUNK, "right")) - 1, i + (1 << (64 - HASH_BITS)), n)
        if j > i:
            out[:, i:j] = _measures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        else:
            j = i + 1
            out[:, i] = _long_measures(data[offsets[i] : offsets[j]])
        i = j
    return out


def _failures(m: np.ndarray) -> np.ndarray:
    words, capitals, symbols, points, distinct = m
    fails = (words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, 100 * capitals > MAX_CAPITAL_PERCENT * points, symbols > 0)
    letters = np.full(len(words), "", object)
    for name, failed in zip(FILTERS, fails):
        letters[failed] += name
    return letters


def _scanned(batches):
    for b in batches:
        texts = pc.fill_null(b["text"], "")
        _, at, raw = texts.buffers()
        offsets = np.frombuffer(at, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
        view = memoryview(raw) if raw is not None else memoryview(b"")
        digests = [hashlib.sha256(view[s:e]).digest() for s, e in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["part"], pa.array(digests, pa.binary()), pa.array(_failures(measures(texts)), pa.string())], names=["doc_id", "part", "digest", "fails"])


def failures(docs: DataFrame) -> DataFrame:
    """docs: doc_id, source, text. Returns doc_id, part, digest (SHA-256 of the text) and fails, those of the letters A to D whose filters the text fails."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("part", "string").add("digest", "binary").add("fails", "string")
    return rows.mapInArrow(_scanned, schema)


def counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """failed: a frame of `failures`. labels: doc_id, quality, toxic. Returns part, fails (letters A to E), n, good, toxic."""
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    rows = failed.groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
    # rows without a doc_id meet no label; their keys are spread by the digest
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.hex("digest")))).join(marked, "key", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    # within these keys each doc_id is one row; at: the rows of the smallest one
    alike = rows.groupBy("digest", "part", "fails", flag("is_good"), flag("is_toxic")).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("at"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    lowest = alike.groupBy("digest").agg(F.min("low").alias("lowest"))
    told = alike.join(lowest, "digest").withColumn("first", F.col("no_id") + F.when(F.col("low") == F.col("lowest"), F.col("at")).otherwise(0))
    told = told.select("part", "is_good", "is_toxic", F.explode(F.array(
        F.struct(F.col("fails"), F.col("first").alias("n")), F.struct(F.concat("fails", F.lit("E")).alias("fails"), (F.col("n") - F.col("first")).alias("n")))).alias("x"))
    some = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0))
    return told.where("x.n > 0").groupBy("part", F.col("x.fails").alias("fails")).agg(F.sum("x.n").alias("n"), some("is_good").alias("good"), some("is_toxic").alias("toxic"))


def audit(counted: DataFrame) -> DataFrame:
    """counted: a frame of `counts`. One row for each part, filter_order and step, as the contract of op13 has them."""
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("c"))  # 32 at most
    orders = by_part.select("part", "c", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    # gone: the step at which documents with these failures go, 6 where they stay
    gone = "coalesce(array_min(transform(filter(split(x.fails, ''), l -> l <> ''), l -> instr(filter_order, l))), 6)"
    orders = orders.withColumn("c", F.expr(f"transform(c, x -> named_struct('fails', x.fails, 'n', x.n, 'good', x.good, 'toxic', x.toxic, 'gone', {gone}))"))
    steps = orders.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"), "c").withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    of = lambda value, where: F.expr(f"aggregate(filter(c, x -> {where}), 0L, (a, x) -> a + {value})")
    return steps.select(
        "part", "filter_order", "step", of("x.n", "x.gone > step").alias("kept"), of("x.n", "x.gone = step").alias("removed"), of("x.n", "contains(x.fails, letter) and x.gone < step").alias("redundant"),
        of("x.n", "x.fails = letter").alias("unique_fails"), of("x.good", "x.gone = step").alias("good_lost"), of("x.toxic", "x.gone = step").alias("toxic_lost"),
        # of the orders of all filters, each failing one comes before the document's other failing ones equally often
        of(f"x.n * ({len(ORDERS)} div length(x.fails))", "contains(x.fails, letter)").alias("shapley"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(counts(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


OP13_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS g, coalesce(bool_or(toxic = 1), false) AS x FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(g, false) AS g, coalesce(x, false) AS x,
    CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > {MAX_CAPITAL_PERCENT} * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN l USING (doc_id)),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM a, a b, a c, a d, a e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, step, substring(filter_order, step, 1) AS k, substring(filter_order, 1, step - 1) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
r AS (SELECT s.*, f.*, contains(fails, k) AS failing, len(before) > 0 AND length(translate(fails, before, '')) < length(fails) AS gone FROM f, s),
z AS (
  SELECT part, filter_order, step, k, count(*) FILTER (WHERE NOT failing AND NOT gone) AS kept, count(*) FILTER (WHERE failing AND NOT gone) AS removed, count(*) FILTER (WHERE failing AND gone) AS redundant,
    count(*) FILTER (WHERE fails = k) AS unique_fails, count(*) FILTER (WHERE failing AND NOT gone AND g) AS good_lost, count(*) FILTER (WHERE failing AND NOT gone AND x) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM z
"""
