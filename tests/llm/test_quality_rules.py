import os

import brute
import pytest

from flowlens.llm import quality_rules as Q

SF = "/root/testdata/sf0.001"
TEXT = "one two three four five six seven eight nine ten, eleven. "
CASES = [
    None, "", " \t\n\x0b\x0c\r ", "\n\n", "short", TEXT, TEXT * 2, TEXT * 3, TEXT + "\n" + TEXT, "ab " * 400, "w " * 7, "w " * 8, "w " * 9,
    " ".join(f"w{i}" for i in range(40)) + ".", " ".join(f"w{i}" for i in range(40)) + "\nHome | About | Contact\nAll rights reserved\nWow!! Buy!! Now!!",
    "Home\nAbout\nContact\n" * 30, "what?! yes!!  no!!\r\n" + TEXT * 2, "ünï cödé 𝒳𝓎 漢字 " * 6 + "#*$%&|<>", "a:: b >> c · d\n" + " ".join(f"x{i}" for i in range(60)) + "!",
    " ".join(f"u{i}" for i in range(30_000)) + ".", "a\nb\na\nb\n\n\na " + TEXT,
]


def test_equals_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(None, TEXT), (3, TEXT * 2), (3, TEXT * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Q.judge(docs).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:] == brute.quality(r["text"]), r["doc_id"]


def test_windows_of_one_hash_are_told_apart_by_their_words(spark, monkeypatch):
    monkeypatch.setattr(Q, "HASH", "pmod(xxhash64({}), 5)")
    texts = [t for t in CASES if len(t or "") < 5000]
    for r in Q.measure(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", "n_repeat_words").collect():
        assert r["n_repeat_words"] == brute.quality(r["text"])[4]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = Q.op2(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {d: brute.quality(t)[:-1] for d, t in texts.items()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r["kept"] for r in got if labels.get(r["doc_id"]) == 1]
    assert sum(good) >= 0.95 * len(good)


def test_clean_keeps_columns_and_only_kept_rows(spark):
    rows = [(i, t, "x", -1, "y") for i, t in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_chars int, fw_text string")
    out = Q.clean(docs)
    assert out.dtypes == docs.dtypes
    want = {i: brute.quality(t)[-1] for i, t in enumerate(CASES) if brute.quality(t)[-2]}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) and r["kept"] == "x" for r in out.collect())


def test_filters_on_the_result_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, TEXT * 2)], "doc_id long, text string")
    assert Q.judge(docs).where("not kept and n_words > 3").count() == int(not brute.quality(TEXT * 2)[-2])
    empty = docs.limit(0)
    assert Q.judge(empty).collect() == Q.clean(empty).collect() == []
