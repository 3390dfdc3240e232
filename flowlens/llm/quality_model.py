"""Quality classifier: Bradley-Terry scores learned from preference pairs.

Each pair prefers a document of quality 1 to one of quality 0; the logistic loss of the difference of their features gives
the weights. A document's score is a logistic function of its weighted features around a quantile of the training scores:
the share of quality 0 among them. Features are SQL expressions on the whole text; labels, lang, source and ids are none.

Training uses every labelled row that is not held out and every pair of them (see learn). Their features are joined with the
labels by Spark and stay in its tables; each Newton step is two jobs, of which sums of a fixed size come to the driver. Pairs
are not listed: what a row's opponents add depends on the scores alone, so a row needs only the counts of theirs on a grid.

Defined results: null text counts as empty and gets a score; rows with a null id are never held out; null labels are
ignored; of repeated labels all take part; with labels of one kind only, every score is that kind's (1 or 0), without any
labels 0.5. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import staged, table

#: Random pairs of a row in `fit`, which takes arrays; training on tables takes every pair.
PAIRS_A_ROW = 10
#: Standardised features are cut off here, on both sides.
EDGE = 8
#: Cells of the grid of scores. A score between two grid points counts for both in proportion.
CELLS = 8192
#: Whole numbers that stand for 1 in a share of a cell and in a feature: sums of them don't depend on their order.
SHARE, UNIT = 1 << 12, 1 << 20
#: Scores as whole numbers of BITS bits, of which a job of `order_statistics` settles DIGIT.
BITS, DIGIT = 48, 12

#: Feature name -> SQL over t (the text), w (its words), n (their number, 1 at least), l (its lines with words).
FEATURES = {
    "log_words": "ln(1 + size(w))",
    "few_words": "case when size(w) < 20 then 1D else 0D end",
    "word_length": "length(array_join(w, '')) / n",
    "symbols": "regexp_count(t, r'[#*$%&<>]') / n",
    "bars": "regexp_count(t, r'[|›»•·]') / n",
    "shouts": r"regexp_count(t, r'[!?]{2,}') / n",
    "capitals": "regexp_count(t, r'[A-ZÀ-Þ]') / n",
    "digits": "regexp_count(t, r'[0-9]') / n",
    "sentences": r"regexp_count(t, r'[.!?](?=[\s]|$)') / n",
    "commas": "regexp_count(t, r',') / n",
    "distinct_words": "size(array_distinct(w)) / n",
    "distinct_pairs": "size(array_distinct(transform(w, (x, i) -> xxhash64(x, get(w, i + 1))))) / n",
    "distinct_lines": "size(array_distinct(l)) / greatest(size(l), 1)",
    "lines": "size(l) / n",
    "ended_lines": r"size(filter(l, x -> rlike(x, r'[.!?…\x22)]\s*$'))) / greatest(size(l), 1)",
}


@dataclass
class Ranker:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    middle: float
    scale: float


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of docs, and x: the features as array<double>."""
    out = docs.select(*keep, F.expr("coalesce(cast(text as string), '')").alias("t"))
    out = out.withColumns({"w": F.expr(r"regexp_extract_all(t, r'[^\x20\x09-\x0D]+', 0)"), "l": F.expr(r"filter(split(t, '\n', -1), x -> rlike(x, r'[^\x20\x09-\x0D]'))")})
    out = out.withColumn("n", F.expr("greatest(size(w), 1)"))
    return out.select(*keep, F.expr("array({})".format(", ".join(f"cast({x} as double)" for x in FEATURES.values()))).alias("x"))


def fit(x: np.ndarray, y: np.ndarray, pairs_a_row: int = PAIRS_A_ROW, ridge: float = 1e-3, rounds: int = 30) -> Ranker:
    """x: a row of features for each label in y (0 or 1). Random pairs of small arrays; see learn for tables."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / spread, -8, 8)
    good, bad = z[y == 1], z[y == 0]
    if not len(good) or not len(bad):
        return Ranker(mean, spread, np.zeros(x.shape[1]), -100.0 if len(good) else 100.0, 1.0)
    pick = np.random.default_rng(7)
    n = pairs_a_row * len(z)
    diff = good[pick.integers(len(good), size=n)] - bad[pick.integers(len(bad), size=n)]
    weights = np.zeros(z.shape[1])
    for _ in range(rounds):  # Newton steps on mean log(1 + exp(-diff . w)) + ridge |w|^2 / 2
        lose = 1 / (1 + np.exp(np.clip(diff @ weights, -30, 30)))
        slope = -(diff * lose[:, None]).mean(0) + ridge * weights
        curve = (diff * (lose * (1 - lose))[:, None]).T @ diff / n + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ weights
    share = (y == 0).mean()
    around = np.quantile(s, [max(0, share - 0.01), min(1, share + 0.01)])
    return Ranker(mean, spread, weights, float(around.mean()), float(s.std() / 4 + 1e-9))


def _moments(rows: DataFrame, values) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and variance of each column of values(batch); a row of each partition comes to the driver."""

    def work(batches):
        n, mean, squares = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                n, mean, squares = _merged((n, mean, squares), _about(values(batch)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([squares.tolist()])], names=["n", "mean", "squares"])

    total = (0, 0.0, 0.0)
    for r in rows.mapInArrow(work, "n long, mean array<double>, squares array<double>").collect():
        total = _merged(total, (r["n"], np.array(r["mean"]), np.array(r["squares"])))
    return total[0], total[1], total[2] / max(total[0], 1)


def _about(m: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    return len(m), m.mean(0), ((m - m.mean(0)) ** 2).sum(0)


def _merged(a, b):
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart**2 * (a[0] * b[0] / n)


def _rounded(values) -> np.ndarray:
    """Without the last digits, in which sums of another order differ."""
    return np.round([float(f"{v:.9g}") for v in values], 10)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    return batch["quality"].to_numpy(zero_copy_only=False).astype(np.int64)


def _grid_sums(rows: DataFrame, standard, weights: np.ndarray, reach: float) -> np.ndarray:
    """By label and grid point: the share of rows there, and the sums of their features. Grid points go from -reach to reach."""
    size = len(weights) + 1

    def work(batches):
        totals = np.zeros((2 * (CELLS + 1), size), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            z = standard(batch)
            at = (z @ weights + reach) * (CELLS / (2 * reach))
            cell = np.clip(np.floor(at), 0, CELLS - 1).astype(np.int64)
            share = np.rint((at - cell) * SHARE).astype(np.int64)[:, None]
            sums = np.column_stack([np.ones(len(z), np.int64), np.rint(z * UNIT).astype(np.int64)])
            key = _labels(batch) * (CELLS + 1) + cell
            order = np.argsort(key, kind="stable")
            key, sums, share = key[order], sums[order], share[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            totals[key[first]] += np.add.reduceat(sums * (SHARE - share), first)
            totals[key[first] + 1] += np.add.reduceat(sums * share, first)
        found = np.flatnonzero(totals[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(totals[found, i]) for i in range(size))], names=["cell", *(f"v{i}" for i in range(size))])

    schema = ", ".join(["cell long", *(f"v{i} long" for i in range(size))])
    out = np.zeros((2 * (CELLS + 1), size))
    for r in rows.mapInArrow(work, schema).groupBy("cell").agg(*(F.sum(f"v{i}") for i in range(size))).collect():  # 2 * (CELLS + 1) rows at most
        out[r[0]] = r[1:]
    return out.reshape(2, CELLS + 1, size) / (SHARE * np.array([1, *[UNIT] * (size - 1)]))


def _squares(rows: DataFrame, standard, weights: np.ndarray, reach: float, factors: np.ndarray) -> np.ndarray:
    """The sum of f z z' over rows, z a row's features and f what factors (by label and grid point) give at its score."""
    size = len(weights)
    grid = np.linspace(-reach, reach, CELLS + 1)

    def work(batches):
        total = np.zeros((size, size))
        for batch in batches:
            z, y = standard(batch), _labels(batch)
            s = z @ weights
            f = np.where(y == 1, np.interp(s, grid, factors[1]), np.interp(s, grid, factors[0]))
            total += (z * f[:, None]).T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["h"])

    return sum((np.array(r["h"]) for r in rows.mapInArrow(work, "h array<double>").collect()), np.zeros(size * size)).reshape(size, size)


def _met(kernel: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each grid point i the sum of kernel[i - j + CELLS] * held[j]: what all grid points j together do to it."""
    n = 1 << (len(kernel) + len(held)).bit_length()
    both = np.fft.rfft(kernel, n).reshape(-1, *[1] * (held.ndim - 1)) * np.fft.rfft(held, n, axis=0)
    return np.fft.irfft(both, n, axis=0)[CELLS : 2 * CELLS + 1]


def order_statistics(rows: DataFrame, score_of, reach: float, ranks: list[int]) -> list[float]:
    """The values of the given ranks (from 0) among the scores score_of(batch), which lie between -reach and reach.

    Each job counts the rows that share the leading bits found so far by their next bits, for all ranks at once.
    """
    prefix, rest, some = [0] * len(ranks), list(ranks), 1 << DIGIT
    for shift in range(BITS - DIGIT, -1, -DIGIT):

        def work(batches, shift=shift, prefix=tuple(prefix)):
            totals = np.zeros((len(prefix), some), np.int64)
            for batch in batches:
                v = np.clip(np.floor((score_of(batch) + reach) * (2**BITS / (2 * reach))), 0, 2**BITS - 1).astype(np.int64) >> shift
                for i, p in enumerate(prefix):
                    totals[i] += np.bincount(v[v >> DIGIT == p] & (some - 1), minlength=some)
            found = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals.ravel()[found])], names=["at", "n"])

        counts = np.zeros(len(ranks) * some, np.int64)
        for r in rows.mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
            counts[r[0]] = r[1]
        for i, upto in enumerate(counts.reshape(len(ranks), some).cumsum(1)):
            digit = int(np.searchsorted(upto, rest[i], "right"))
            rest[i] -= int(upto[digit - 1]) if digit else 0
            prefix[i] = prefix[i] << DIGIT | digit
    return [(p + 0.5) * (2 * reach / 2**BITS) - reach for p in prefix]


def learn(rows: DataFrame, ridge: float = 1e-3, rounds: int = 30) -> Ranker:
    """rows: quality (0 or 1), x (the features); read several times. Every pair of a row of each label counts once.

    Newton steps on the mean of log(1 + exp(-difference of scores)) over all pairs, + ridge |w|^2 / 2. Between two of CELLS
    grid points what a pair adds is taken as linear.
    """
    n, mean, spread = _moments(rows, lambda b: np.column_stack([_labels(b), _matrix(b)]))
    if not n:
        return Ranker(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0, 1.0)
    good, mean, spread = round(mean[0] * n), _rounded(mean[1:]), _rounded(np.sqrt(spread[1:])) + 1e-9
    weights = np.zeros(len(mean))
    if good in (0, n):
        return Ranker(mean, spread, weights, -100.0 if good else 100.0, 1.0)

    def standard(batch):
        return np.clip((_matrix(batch) - mean) / spread, -EDGE, EDGE)

    pairs, best = good * (n - good), (np.inf, weights)
    for _ in range(rounds):
        reach = max(1.0, EDGE * np.abs(weights).sum())
        sums = _grid_sums(rows, standard, weights, reach)
        count, total = sums[:, :, 0], sums[:, :, 1:]
        apart = np.arange(-CELLS, CELLS + 1) * (2 * reach / CELLS)
        loss = count[1] @ _met(np.logaddexp(0, -apart), count[0]) / pairs + ridge * weights @ weights / 2
        if loss > best[0] + 1e-4:  # a step too far
            weights = (weights + best[1]) / 2
            continue
        best = (loss, weights)
        lose = np.exp(-np.logaddexp(0, apart))
        curved = lose * (1 - lose)
        slope = (_met(lose[::-1], count[1]) @ total[0] - _met(lose, count[0]) @ total[1]) / pairs + ridge * weights
        crossed = total[1].T @ _met(curved, total[0])
        squares = _squares(rows, standard, weights, reach, np.stack([_met(curved, count[1]), _met(curved, count[0])]))
        step = np.linalg.solve((squares - crossed - crossed.T) / pairs + ridge * np.eye(len(weights)), slope)
        weights = weights - step
        if np.abs(step).max() < 1e-5:
            break
    weights = _rounded(weights)
    reach = max(1.0, EDGE * np.abs(weights).sum())
    _, _, variance = _moments(rows, lambda b: (standard(b) @ weights)[:, None])
    share = 1 - good / n
    places = [(n - 1) * q for q in (max(0, share - 0.01), min(1, share + 0.01))]
    ranks = [min(int(p) + i, n - 1) for p in places for i in (0, 1)]
    v = order_statistics(rows, lambda b: standard(b) @ weights, reach, ranks)
    around = [v[2 * i] + (v[2 * i + 1] - v[2 * i]) * (p - int(p)) for i, p in enumerate(places)]
    middle, scale = _rounded([np.mean(around), np.sqrt(variance[0]) / 4]).tolist()
    return Ranker(mean, spread, weights, middle, scale + 1e-9)


def _learned(found: DataFrame, labels: DataFrame) -> Ranker:
    """found: doc_id, x."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return learn(staged(found.join(marked.where(~held_out("doc_id")), "doc_id").select("quality", "x")))


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """labels: doc_id, quality. Uses every labelled row that is not held out."""
    return _learned(features(docs.select("doc_id", "text"), "doc_id"), labels)


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Ranker, *keep: str) -> DataFrame:
    """The columns keep of docs, and score."""
    return _scored(features(docs, *keep), model, *keep)


def _scored(found: DataFrame, model: Ranker, *keep: str) -> DataFrame:
    terms = " + ".join(
        f"{w:.10e} * greatest(-8D, least(8D, (x[{i}] - ({m:.10e})) / {s:.10e}))" for i, (w, m, s) in enumerate(zip(model.weights, model.mean, model.spread)))
    return found.select(*keep, F.expr(f"1 / (1 + exp(-(({terms}) - ({model.middle:.10e})) / {model.scale:.10e}))").alias("score"))


def op6(spark, sf_dir: str) -> DataFrame:
    found = staged(features(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))  # read for training and for scores
    out = _scored(found, _learned(found, table(spark, sf_dir, "labels")), "doc_id")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
