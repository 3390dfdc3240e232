import random

import brute
import duckdb
import pandas as pd

from flowlens.llm import decontaminate as D


def tables(seed=1):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gämma", "δ", "e5", "zeta", "漢字"]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([3, 1, 12, 30, 10, 9, 0, 15, 40])]
    items += [(3, items[3][1]), (77, items[4][1]), (78, None), (None, items[2][1]), (79, "...")]
    docs = []
    for i in range(60):
        parts = [" ".join(r.choice(words) + r.choice(["", ",", "!", " -"]) for _ in range(r.randint(0, 40)))]
        if i % 2:
            w = (items[r.choice([2, 3, 4, 7, 8])][1] or "").split()
            at = r.randint(0, max(0, len(w) - 10))
            parts += [(" " if i % 4 == 1 else ", ").join(w[at : at + r.randint(8, 14)]).upper() if i % 3 else " ".join(w), "tail"]
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "?!"), (None, items[3][1]), (103, items[3][1]), (103, items[3][1]), (104, "x " * 50_000 + items[3][1])]
    return docs, items


def test_equals_plain_python_with_one_block_or_many(spark):
    docs, items = tables()
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((d, *brute.contamination(t, items)) for d, t in docs), key=str)
    for limit in (D.BLOCK_BYTES, 200):
        assert sorted(map(tuple, D.digest(D.find_overlaps(rows, bench, block_bytes=limit)).collect()), key=str) == want
        kept = D.drop_contaminated(rows, bench, block_bytes=limit)
        assert kept.dtypes == rows.dtypes
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted((d, t) for d, t in docs if not brute.contamination(t, items)[-1])


def test_offsets_lead_to_the_original_text(spark):
    item = "Which river, in the far north, runs past the old mill and the church?"
    text = "Ünrelated start; WHICH river in the far -- north runs\npast the OLD mill and the church... end"
    found = D.find_overlaps(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [text[x["a"] : x["b"]] for x in found["hit_chars"]] == ["WHICH river in the far -- north runs\npast the OLD mill and the church"]
    assert found["items"] == ["7"]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert tuple(D.digest(D.find_overlaps(docs, bench.limit(0))).first()) == (1, 2, 0, 0, brute.sha(""), False)
    assert D.find_overlaps(docs.limit(0), bench).collect() == D.drop_contaminated(docs.limit(0), bench).collect() == []
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 1


def test_sql(spark):
    docs, items = tables(2)
    docs, items = {d: t for d, t in docs if d is not None}, {i: t for i, t in items if i is not None}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs.items(), columns=["doc_id", "text"]).astype({"doc_id": "int64", "text": object}))
    con.register("benchmark", pd.DataFrame(items.items(), columns=["item_id", "text"]).astype({"item_id": "int64", "text": object}))
    assert sorted(con.sql(D.OP4_SQL).fetchall()) == sorted((d, *brute.contamination(t, items.items())) for d, t in docs.items())
