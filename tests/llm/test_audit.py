from itertools import permutations

import brute
import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from flowlens.llm import audit, scan

TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "a", "a b a", "w " * 60, " ".join(f"w{i}" for i in range(60)), "Ab " * 50, "x#y", "UPPER CASE", "é ü 漢字 😀 " * 20, " a b", "one|two three",
    " ".join(f"w{i}" for i in range(60)), "a" * 7 + " " + "a" * 8 + " " + "a" * 9 + " " + "a" * 9, "long" * 40 + "x " + "long" * 40 + "y " + "long" * 40 + "x",
]


def measured(text):
    text = text or ""
    words = brute.WORD.findall(text)
    return len(words), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text), len(text), len(set(words))


def fails(text):
    words, capitals, symbols, points, distinct = measured(text)
    return {k for k, f in zip("ABCD", (words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * points, symbols)) if f}


def by_hand(docs, labels):
    """docs: doc_id, source, text; labels: doc_id, quality, toxic. The rows of op13, each order applied document by document."""
    found = []
    for d, source, text in docs:
        failing = fails(text)
        if d is not None and any(o is not None and o < d and (t or "") == (text or "") for o, _, t in docs):
            failing.add("E")
        mine = [x for x in labels if d is not None and x[0] == d]
        found.append((source or "", failing, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, removed = {}, {}
    for part in {x[0] for x in found}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in found if x[0] == part]
            every = left
            for step, k in enumerate(order, 1):
                gone, left = [x for x in left if k in x[1]], [x for x in left if k not in x[1]]
                out[part, order, step] = [len(left), len(gone), sum(k in x[1] for x in every) - len(gone), sum(x[1] == {k} for x in every), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                removed[part, k] = removed.get((part, k), 0) + len(gone)
    return {(*key, *v, removed[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


DOCS = [(i, f"s{i % 3}" if i % 4 else None, t) for i, t in enumerate(TEXTS)] + [
    (1, "s1", ""), (1, "s1", ""), (2, "s2", "a"), (None, "s1", "a"), (None, None, None), (90, "", "x#y"), (90, "", "x#y"), (91, "s0", "w " * 60), (-5, "s0", "a b a")]
LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(12)] + [(90, 0, 0), (90, 1, None), (91, None, 1), (None, 1, 1), (500, 1, 1)]


def frames(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, source string, text string, fails string, n int")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_every_order_equals_filtering_by_hand(spark):
    docs, labels = frames(spark)
    got = audit.audit(audit.counts(audit.failures(docs), labels)).collect()
    assert len(got) == len({(r["part"], r["filter_order"], r["step"]) for r in got})
    assert {tuple(r) for r in got} == by_hand(DOCS, LABELS)


def test_the_query_equals_its_sql(spark, tmp_path):
    docs, labels = frames(spark)
    docs.where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    out, want = audit.op13(spark, str(tmp_path)), con.sql(audit.OP13_SQL)
    assert sorted(out.columns) == sorted(want.columns)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.select(", ".join(out.columns)).fetchall()}


def test_measures_of_whole_texts(monkeypatch):
    texts = [*TEXTS, "wörd Öther # " * 9, "x" * 300, "A" * 300 + " b " + "A" * 300, " " * 500, ("ab cd " * 50 + "é" * 90) * 3]
    want = [measured(t) for t in texts]
    for chunk, bits in ((1 << 20, 52), (64, 52), (64, 3), (1 << 20, 3), (17, 52), (16, 3)):
        monkeypatch.setattr(scan, "CHUNK", chunk)
        monkeypatch.setattr(audit, "HASH_BITS", bits)
        for array in (pa.array(texts), pa.array(["skip", *texts, "skip"])[1:-1]):
            assert [tuple(c) for c in audit.measures(array).T.tolist()] == want, (chunk, bits)


def test_a_very_long_text_and_a_very_long_word():
    words = " ".join(f"w{i % 70_000}" for i in range(900_000))
    for text in (words, "Ü#" * 1_500_000, words + " " + "Zz" * 1_200_000 + " " + words):
        assert tuple(audit.measures(pa.array([text, "a b"])).T.tolist()[0]) == measured(text)


@pytest.mark.parametrize("size", [1, 5, 8, 9, 63, 64, 65, 200])
def test_bytes_are_compared_whole(size):
    data = np.frombuffer(b"q" * size + b"q" * (size - 1) + b"r" + b"q" * size, np.uint8)
    at = np.array([0, 0, size])
    assert scan.differ(data, at, np.array([size, 2 * size, 2 * size]), np.array([size] * 3)).tolist() == [True, False, True]


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert audit.audit(audit.counts(audit.failures(docs.limit(0)), labels)).collect() == []
    rows = audit.audit(audit.counts(audit.failures(docs), labels.limit(0))).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(rows) == (0, 0)
