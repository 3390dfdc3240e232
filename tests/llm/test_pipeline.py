import random

import brute
import sentencepiece

import corpus_pipeline
from flowlens.llm import pieces, secrets, tokens

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    words = [f"word{i}" for i in range(300)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    items = [(i, make(14)) for i in range(3)]
    base = [make(60) for _ in range(8)]
    texts = [*base, *base[:3], base[4].replace("word1", "word2", 1), base[5] + " end.", None, "", "short text", "Home\nAbout\nContact\n" * 20, base[6] + " " + items[0][1] + " tail", make(30) + " password=hunter2222 " + make(20)]
    texts += [make(40) + "\nSign up for our letter\n" + make(10), make(25) + " token: 0123456789abcdef0123456789abcdef " + make(5), base[0]]
    return [(100 - i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], items


def run(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_equals_plain_python(spark, tmp_path):
    rows, items = corpus()
    docs = [(d, brute.quality(t)[-1]) for d, t, *_ in rows if brute.quality(t)[-2]]
    docs = [(d, t) for (d, t), (_, _, c) in zip(docs, brute.components(docs)) if d == c]
    docs = [(d, t) for d, t in docs if not brute.contamination(t, items)[-1]]
    model = secrets.train(secrets.default_samples(spark))
    spans = {r["doc_id"]: r["found"] for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    clean = {}
    for d, t in docs:
        assert {(k, s, e) for k, s, e in brute.base_spans(t, brute.SECRET_KINDS)} <= {(x["kind"], x["s"], x["e"]) for x in spans[d]}
        hidden = {i for x in spans[d] for i in range(x["s"], x["e"])}
        clean[d] = "".join("" if i in hidden and i - 1 in hidden else "[SECRET]" if i in hidden else c for i, c in enumerate(t))
    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.as_unigram(open(tokens.MODEL, "rb").read()))
    got = {r["doc_id"]: (r["ids"], r["n_tokens"], r["round_trip"]) for r in run(spark, tmp_path, rows, items).collect()}
    want = {d: (library.encode(t), len(library.encode(t)), True) for d, t in clean.items()}
    assert got == want and 5 < len(got) < len(rows) - 6 and any("[SECRET]" in t for t in clean.values())


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, COLUMNS)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "decontamination", "secret_scans", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, [], []).collect() == []
