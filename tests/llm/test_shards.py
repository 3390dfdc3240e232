import collections

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import shards as S


def test_feistel_is_a_permutation_with_an_inverse():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        slots = S.slots_of(np.arange(n), n)
        assert sorted(slots) == list(range(n))
        assert (S.index_of(slots, n) == np.arange(n)).all()
    assert (S.slots_of(np.arange(1000), 1000) != S.slots_of(np.arange(1000), 1000, key=5)).any()


def test_long_texts_get_the_same_ids(monkeypatch):
    class Held:
        value = S._read_ranks(S.RANKS)

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": ["hello <|endoftext|> world", "", None, "éß😀 漢字  x"]})
    found = [(d, list(x)) for d, x in S._ids([batch], Held, "a")]
    monkeypatch.setattr(S, "LONG", 0)
    assert [d for d, _ in found] == [1, 2, 4] and found == [(d, x.tolist()) for d, x in S._ids([batch], Held, "a")]


def test_shards_hold_every_sequence_once(spark, tmp_path):
    texts = ["hello world " * k for k in range(40)] + ["", None, "éß😀", "x" * 3000] + ["again and again"] * 3
    rows = [(i if i != 7 else None, t, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(3).cache()
    found = S.write_shards(docs, str(tmp_path / "out"), length=16, per_shard=7).collect()
    n = len(found)
    assert sorted(r["slot"] for r in found) == list(range(n))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".bin") == [f"shard-{i:08d}.bin" for i in range(-(-n // 7))]
    import tiktoken

    encoding = tiktoken.Encoding("t", pat_str=S.PATTERN, mergeable_ranks=S._read_ranks(S.RANKS), special_tokens={})
    read = list(S.read_slots(str(tmp_path / "out"), 0, n, 16, 7))
    assert all((a == b).all() for a, b in zip(read[n // 2 :], S.read_slots(str(tmp_path / "out"), n // 2, n - n // 2, 16, 7)))
    order = S.slots_of(np.arange(n), n)  # sequence i is in slot order[i]: laid end to end the texts come back
    flat = np.concatenate([read[s] for s in order]).tolist()
    by_slot = {r["slot"]: r for r in found}
    kept = [x for i, s in enumerate(order) for x in read[s][: by_slot[s]["n_ids"]].tolist()]
    got, now = collections.Counter(), []
    for x in kept:
        if x == S.END:
            got[encoding.decode(now)] += 1
            now = []
        else:
            now.append(x)
    assert not now and len(flat) == 16 * n
    assert got == collections.Counter(t for t in texts if t is not None)
    assert {d for r in found for d in r["doc_ids"]} == {r[0] for r in rows if r[1] is not None}


def test_empty_table(spark, tmp_path):
    assert S.write_shards(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e")).collect() == []


def test_ids_that_do_not_fit_are_refused(spark, tmp_path):
    path = tmp_path / "large.tiktoken"
    path.write_bytes(b"YQ== 0\nYg== 70000\n")
    with pytest.raises(ValueError, match="65535"):
        S.write_shards(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), str(tmp_path / "o"), ranks_path=str(path))


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb c\n\n", "it's  'll x'll y", "a\u00a0 b", "a\u3000b c", "é😀 漢字 ١٢ 12", "\u2028 x", "x \x85", "\x1c \x1f a", "<|endoftext|> 5% of"]


def test_words_encoded_apart_give_the_ids_of_the_whole_text(monkeypatch):
    class Held:
        value = S._read_ranks(S.RANKS)

    r = np.random.default_rng(5)
    signs = list("ab'st 1!\n\t") + [" "] * 6 + ["é", "漢", "😀", "\u00a0", "\u2003", "\x85", "\u200b", "\u180e", "\x1c", "\r\n"]
    texts = [*ODD, None, *("".join(r.choice(signs, size=int(k))) for k in r.integers(0, 40, 3000)), *ODD]
    encoder, _ = S._encoder(Held, "w")
    want = [(i, encoder.encode_ordinary(t)) for i, t in enumerate(texts) if t is not None]
    for size in (1 << 20, 100, 1):
        monkeypatch.setattr(S, "SLICE_BYTES", size)
        batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts)))[a:b], "text": pa.array(texts[a:b], pa.string())}) for a, b in ((0, 9), (9, 9), (9, len(texts)))]
        assert [(d, x.tolist()) for d, x in S._ids(batches, Held, "w")] == want
        assert S._n_ids(batches, Held, "w") == sum(len(x) + 1 for _, x in want)


def test_a_word_is_encoded_once_a_slice(monkeypatch):
    import tiktoken

    class Held:
        value = S._read_ranks(S.RANKS)

    given, real = [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: given.append(text) or real(self, text))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": ["the council mended a bridge " * 40 + "again"] * 50})
    found = list(S._ids([batch], Held, "once"))
    assert len(found) == 50 and sum(map(len, given)) < 1000  # of 56,250 characters
