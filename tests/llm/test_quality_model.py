import os
import re
import zlib

import numpy as np
import pytest

from flowlens.llm import quality_model as Q

SF = "/root/testdata/sf0.01"
GOOD = "The council met on Monday. It agreed, after a long debate, to repair the bridge number {i} before winter."
BAD = "BUY NOW!!! $$$ | home | about | click {i} {i} {i} !!! ### buy buy buy"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def tables(spark, n=60):
    docs = spark.createDataFrame([(i, (GOOD if i % 2 else BAD).format(i=i), "x") for i in range(n)] + [(n, None, "x"), (n + 1, "", "x"), (None, GOOD, "x"), (3, GOOD, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(n)] + [(5, None, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_learns_pairs_and_scores_every_row(spark):
    docs, labels = tables(spark)
    got = Q.score(docs, Q.train(docs, labels), "doc_id").collect()
    assert len(got) == 64 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in got if r["doc_id"] is not None and r["doc_id"] < 60)


def test_held_out_labels_are_never_used(spark):
    docs, labels = tables(spark)
    turned = labels.withColumn("quality", Q.F.when(Q.held_out("doc_id"), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.middle == b.middle
    assert {r["doc_id"]: r["h"] for r in docs.where("doc_id is not null").select("doc_id", Q.held_out("doc_id").alias("h")).collect()} == {i: held(i) for i in range(62)}


def test_few_labels(spark):
    docs, labels = tables(spark)
    one = lambda model: {round(r["score"], 3) for r in Q.score(docs, model, "doc_id").collect()}
    assert one(Q.train(docs, labels.limit(0))) == {0.5}
    assert one(Q.train(docs, labels.where("quality = 1"))) == {1.0} and one(Q.train(docs, labels.where("quality = 0"))) == {0.0}
    assert Q.score(docs.limit(0), Q.train(docs, labels), "doc_id").collect() == []


def test_the_fit_lowers_the_pairwise_loss():
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 500)
    x = r.normal(size=(500, 4)) + y[:, None] * [2, 0, 0, 0]
    model = Q.fit(x, y)
    assert model.weights[0] > 3 * np.abs(model.weights[1:]).max()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in Q.op6(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(held(r["doc_id"]) for r in got)
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in got])
    assert len(got) > 50 and right >= 0.9, right


def test_sentence_marks_count_before_blanks_and_at_ends(spark):
    texts = ["Hello there. Bye now! Ok.", 'He said "no."\nopen line\n(so) be it) \nlast', "a.b c\\ s", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = list(Q.FEATURES).index
    got = [(r["x"][at("sentences")], r["x"][at("ended_lines")]) for r in Q.features(docs, "doc_id").orderBy("doc_id").collect()]
    assert got == [(pytest.approx(3 / 5), 1.0), (0.0, 0.5), (0.0, 0.0), (0.0, 0.0)]


def test_fit_equals_plain_gradient_descent():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 4)) * [1, 5, 0.1, 2] + [0, 3, -1, 8]
    y = (x @ [1.0, 0.2, -3.0, 0.0] + r.normal(size=300) > 0.5).astype(int)
    model = Q.fit(x, y)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    pick, n = np.random.default_rng(7), Q.PAIRS_A_ROW * len(z)  # the same pairs
    good, bad = z[y == 1], z[y == 0]
    diff = good[pick.integers(len(good), size=n)] - bad[pick.integers(len(bad), size=n)]
    loss = lambda w: np.mean(np.log1p(np.exp(-diff @ w))) + 1e-3 * w @ w / 2
    weights = np.zeros(4)
    for _ in range(4000):
        weights += 0.5 * ((diff / (1 + np.exp(diff @ weights))[:, None]).mean(0) - 1e-3 * weights)
    assert np.allclose(model.weights, weights, atol=1e-3)
    assert loss(model.weights) <= loss(weights) + 1e-9 < loss(np.zeros(4))


def test_features_equal_plain_python(spark):
    texts = [GOOD, BAD, "", "one", "a b a b\nC, D! 12 | x\n\n#é?! «É».", "Ends here.\n(no end)\nquote\"  \n" * 3]

    def plain(t):
        w, l = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, c = max(len(w), 1), lambda p: len(re.findall(p, t))
        return [
            np.log(1 + len(w)), float(len(w) < 20), len("".join(w)) / n, c(r"[#*$%&<>]") / n, c("[|›»•·]") / n, c("[!?]{2,}") / n, c("[A-ZÀ-Þ]") / n, c("[0-9]") / n, c(r"[.!?](?=[ \t\n\x0B\f\r]|$)") / n, c(",") / n,
            len(set(w)) / n, len({(a, b) for a, b in zip(w, [*w[1:], None])}) / n, len(set(l)) / max(len(l), 1), len(l) / n, sum(bool(re.search(r'[.!?…")][ \t\n\x0B\f\r]*$', x)) for x in l) / max(len(l), 1),
        ]

    for r in Q.features(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect():
        assert np.allclose(r["x"], plain(r["text"])), r["text"]


def labelled(spark, x, y):
    return spark.createDataFrame(list(zip(y.tolist(), x.tolist())), "quality int, x array<double>").repartition(3).cache()


def test_learn_equals_gradient_descent_on_every_pair(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 4)) * [1, 5, 0.1, 2] + [0, 3, -1, 8]
    y = (x @ [1.0, 0.2, -3.0, 0.0] + r.normal(size=300) > 0.5).astype(int)
    model = Q.learn(labelled(spark, x, y))
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
    weights = np.zeros(4)
    for _ in range(1500):
        weights += 0.5 * ((diff / (1 + np.exp(diff @ weights))[:, None]).mean(0) - 1e-3 * weights)
    assert np.allclose(model.weights, weights, atol=1e-3)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, x.std(0))
    s, share = z @ model.weights, (y == 0).mean()
    assert model.middle == pytest.approx(np.quantile(s, [share - 0.01, share + 0.01]).mean(), abs=1e-6)
    assert model.scale == pytest.approx(s.std() / 4, abs=1e-6)


def test_order_statistics_of_equal_and_far_values(spark):
    s = np.concatenate([np.zeros(50), np.random.default_rng(2).normal(size=200), [-7.5, 7.5, 7.5, 1e-9]])
    rows = labelled(spark, s[:, None], np.zeros(len(s), int))
    ranks = [0, 1, 99, 100, 101, 140, len(s) - 2, len(s) - 1]
    got = Q.order_statistics(rows, lambda b: b["x"].flatten().to_numpy(zero_copy_only=False), 8.0, ranks)
    assert np.allclose(got, np.sort(s)[ranks], atol=1e-12)


def test_every_labelled_row_takes_part(spark):
    n = 36_000  # 24,000 of them not held out, the old bound was 20,000
    docs = spark.range(n).selectExpr("id as doc_id", "repeat('word ', cast(1 + id % 97 as int)) || if(id % 3 = 0, '# | !!', 'the end.') as text").repartition(4)
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 3 != 0 as int) as quality")
    model = Q.train(docs, labels)
    sizes = np.array([np.log(1 + (1 + i % 97) + (3 if i % 3 == 0 else 2)) for i in range(n) if not held(i)])
    assert len(sizes) > 20_000
    assert model.mean[0] == pytest.approx(sizes.mean(), rel=1e-8) and model.spread[0] == pytest.approx(sizes.std(), rel=1e-7)
