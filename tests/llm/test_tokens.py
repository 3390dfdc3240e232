import os
import random

import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from flowlens.llm import pieces, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.MODEL), reason="no vocabulary")
SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  two  blanks ", "▁mark ▁ inside", "tab\tand\nline", "ünï cödé 漢字 😀 ‍", "a" * 3000, "\x00\x01", "Hello, world! 12345 foo_bar(x) == 7;",
    "<s> </s> <unk> <0x41>", "   ", "�", "é", "x " * 5000,
]


def rows(spark):
    made = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "text"), (3, ODD[3])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in made], "doc_id long, text string, ids string")
    if os.path.isdir(SF):
        docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "'x' as ids"))
    return docs


def library(kind):
    """The library's tokenizer for MODEL, read as the file says or as a unigram vocabulary."""
    blob = open(tokens.MODEL, "rb").read()
    return sentencepiece.SentencePieceProcessor(model_proto=pieces.as_unigram(blob) if kind else blob)


@pytest.mark.parametrize("kind", [None, "unigram"])
def test_equals_the_library(spark, kind):
    lib = library(kind)
    got = [r for r in tokens.encode_checked(rows(spark), kind=kind).collect()]
    for r in got:
        if r["text"] is None:
            assert (r["ids"], r["n_tokens"], r["round_trip"]) == (None, 0, None)
            continue
        assert r["n_tokens"] == len(r["ids"])
        assert r["round_trip"] or "▁" in r["text"]
        want = lib.encode(r["text"])
        assert r["ids"] == want, r["text"][:50]


@pytest.mark.parametrize("kind", [None, "unigram"])
def test_counts_and_decoding(spark, kind):
    lib = library(kind)
    docs = rows(spark)
    ids = {r["doc_id"]: r["ids"] for r in tokens.encode(docs.where("doc_id <> 3"), kind=kind).collect()}
    for r in tokens.count(docs.where("doc_id <> 3"), kind=kind).collect():
        assert r["n_tokens"] == len(ids[r["doc_id"]] or ())
    for r in tokens.decode(tokens.encode(docs, kind=kind), kind=kind).collect():
        assert r["decoded"] == (None if r["text"] is None else lib.decode(r["ids"]))


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, IDS string, n_tokens string, decoded string")
    assert tokens.encode_checked(docs).collect() == tokens.count(docs).collect() == []
    assert tokens.encode(docs).columns == ["doc_id", "text", "n_tokens", "decoded", "ids"]


def unigram(seed):
    """A unigram model with many equal scores."""
    r = random.Random(seed)
    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0, type=kind)
    for b in range(256):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    words = {"▁", *"abcd"} | {("▁" if r.random() < 0.4 else "") + "".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(150)}
    for w in sorted(words):
        m.pieces.add(piece=w, score=-r.choice([1, 2, 2.5, 3, 4]) * len(w), type=1)
    return m.SerializeToString()


@pytest.mark.parametrize("seed", range(4))
def test_unigram_equals_the_library(seed):
    blob = unigram(seed)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=blob), pieces.PieceModel(blob)
    r = random.Random(seed)
    texts = ["".join(r.choice("abcd  é漢") for _ in range(r.randint(0, 60))) for _ in range(400)] + ["", " "]
    want = library.encode(texts, num_threads=1)
    score = lambda ids: sum(library.get_score(i) if not library.is_byte(i) else 0 for i in ids)
    got = own.encode(pa.array(texts)).to_pylist()
    assert [own.decode(pa.array([g], pa.list_(pa.int32()))).to_pylist()[0] for g in got] == texts
    assert own.count(pa.array(texts)).tolist() == [len(g) for g in got]
    for g, w in zip(got, want):
        assert score(g) == pytest.approx(score(w))
    assert got == want
