import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import ngram_join as J
from flowlens.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent=80):
    """doc_id -> (n_shingles, component_id) by comparing all pairs."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low_id = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low_id[find(i)] = min(d, low_id.get(find(i), d))
    return sorted(((d, len(sets[i]), low_id[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    out = []
    for g in range(6):
        base = [r.choice(words) for _ in range(r.choice([8, 30, 90, 140]))]
        for _ in range(r.choice([2, 8, 25])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
    out += [" ".join(r.choice(words) for _ in range(r.randint(5, 40))) + " " + passage for _ in range(20)]
    out += ["", None, "  \n", "one", "ONE", "a b c", "A  b\tc", "a b c d e", "ÄB c d e f", "äB c d e f"]
    r.shuffle(out)
    rows = list(enumerate(out, 100))
    return rows + [(None, out[0]), (rows[3][0], rows[3][1]), (rows[5][0], "again other words under one id here")]


@pytest.mark.parametrize("options", [{}, {"chunk": 900, "split": 3, "small": 2, "hints": 50, "cost": 4}, {"hints": 0, "chunk": 1500, "cost": 1}])
def test_equals_comparing_all_pairs(spark, options):
    rows = corpus(len(options) + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, J.components(docs, **options).collect()), key=str) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, node long, lead string")
    assert J.components(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z")], "doc_id long, text string, component_id string")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted(docs.where("doc_id = 1 or doc_id is null").collect(), key=str)


@pytest.mark.parametrize("small", [J.SMALL, 1])
def test_keep_one_judges_rows_of_one_id_by_their_texts(spark, small):
    apart = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcdefg"]
    near = lambda t: t + " end"
    rows = [
        (1, apart[0], "x"), (1, apart[1], "y"), (2, apart[2], "z"),  # three texts without a common word: all stay
        (3, near(apart[0]), "w"), (1, near(apart[1]), "v"),  # a near copy of another id, one under the same id
        (4, apart[3], "b"), (4, apart[3], "a"), (5, near(apart[3]), "c"),  # repeated rows of the smallest id: one
        (7, apart[4], "d"), (7, apart[4], "e"), (6, near(apart[4]), "f"),  # of a larger id: none
        (8, None, "g"), (8, None, "g"), (8, "", "h"), (None, apart[0], "i"), (None, apart[0], "i"),
    ]
    docs = spark.createDataFrame(rows, "doc int, text string, hash string").withColumnRenamed("doc", "doc_id").withColumn("row", F.col("hash")).withColumn("doc", F.create_map("hash", "hash")).repartition(3)
    kept = J.keep_one(docs, small=small)
    assert kept.dtypes == docs.dtypes
    first = min((r["h"], r["text"]) for r in spark.createDataFrame(rows, "d int, text string, s string").where("d = 1").selectExpr("text", "xxhash64(text) as h").collect() if r["text"].startswith("b"))[1]
    want = [(1, apart[0], "x"), (1, first, "y" if first == apart[1] else "v"), rows[2], (4, apart[3], "a"), rows[10], *rows[11:]]
    assert sorted(map(tuple, kept.select("doc_id", "text", "hash").collect()), key=str) == sorted(want, key=str)


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:140_000])), (3, " ".join(words[:100_000])), (4, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.components(docs).collect())) == [(1, 149_996, 1), (2, 139_996, 1), (3, 99_996, 3), (4, 1, 4)]


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (500, 499)]
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{200 + i: 200 for i in range(50)}, 499: 499, 500: 499}


def test_sketches_never_hide_a_link():
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: int(r.integers(0, n + 1))], r.integers(0, 1 << 63, int(r.integers(0, n + 1))).astype(np.uint64)])
        sizes = np.array([len(a), len(b)])
        found = J.sketches(np.repeat([0, 1], sizes), np.concatenate([a, b]), sizes, sizes > 0).to_pylist()
        if len(b):
            assert J.differing_bits(*found) <= len(set(a.tolist()) ^ set(b.tolist()))
            assert J.differing_bits(found[0], found[0]) == 0


def test_company_is_found_by_any_pivot():
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = [base, base[:190], r.integers(0, 1 << 63, 150).astype(np.uint64), base[5:], r.integers(0, 1 << 63, 900).astype(np.uint64)]
    n = np.array([len(x) for x in sets])
    found = J.sketches(np.repeat(np.arange(5), n), np.concatenate(sets), n, n > 0).to_pylist()
    assert J.have_company(found, n, 80)[[0, 1, 3]].all()
    assert J.have_company(found[:3], n[:3], 80).tolist() == [True, True, False]
    assert J.have_company(found[:1], n[:1], 80).tolist() == [False]
