import hashlib
import random

import brute
import numpy as np
import pytest

from flowlens.llm import fingerprints as P
from flowlens.llm import scan


def jaccard(a, b):
    a, b = brute.shingles(a), brute.shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def by_hand(rows):
    """doc_id, n_chars, digest of the edited text, edited text, next text of rows with a doc_id, by doc_id and text."""
    rows = sorted((d, t or "") for d, t in rows if d is not None)
    out = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, after))
    return out


def slow_codes(text):
    """The code of each bin of one text, bin by bin in plain Python."""
    words = brute.WORD.findall(text.translate(brute.LOW))
    m64 = (1 << 64) - 1

    def mix(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & m64
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & m64
        return h ^ (h >> 31)

    def word(w):
        raw, h, p = w.encode(), 0, 1
        for c in raw:
            h, p = (h + mix((c + 1) * 0xD1B54A32D192ED03 & m64) * p) & m64, p * (0x9E3779B97F4A7C15 | 1) & m64
        return mix((h + len(raw)) & m64)

    hashes = [word(w) for w in words]
    windows = [hashes[i : i + 5] for i in range(len(hashes) - 4)] if len(words) >= 5 else [hashes] if words else []
    least = {}
    for w in windows:
        h = mix(sum(x * odd for x, odd in zip(w, P._ODD)) & m64)
        b, v = h >> 55, h >> 10 & (1 << 45) - 1
        least[b] = min(v, least.get(b, m64))
    out = []
    for b in range(512):
        at = b if b in least else min(least, key=lambda j: (mix(b * 512 + j + 0x5DEECE66D), j))
        out.append(mix(least[at] ^ mix(b + 1)) & 15)
    return out


def test_codes_equal_plain_python():
    pick = random.Random(3)
    texts = ["a", "one Two three", "one two three four five", "é ü 漢字 😀 x y z", " ".join(pick.choice("abcdefgh") for _ in range(60)), " ".join(f"w{pick.randrange(900)}" for _ in range(700))]
    code, some = P.codes(texts)
    assert some.all() and [slow_codes(t) for t in texts] == code.tolist()


@pytest.mark.parametrize("chunk", [8, 40, 300])
def test_pieces_give_the_same_codes(chunk, monkeypatch):
    texts = ["", " ", "a b", " ".join(f"w{i * 7919 % 101}" for i in range(300)), "x " * 200, "aa bb cc dd", "é 漢字 " * 30]
    want = [P.packed(*P.codes([t]))[0] for t in texts]
    monkeypatch.setattr(scan, "CHUNK", chunk)
    assert P.packed(*P.codes(texts)) == want


def test_very_long_texts_and_words():
    long = " ".join(f"w{i % 50_000}" for i in range(400_000))
    word = "x" * 2_500_000
    code, some = P.codes([long, long + " end", "a " + word + " b", "a " + word + " b", "a " + word[:-1] + "y b"])
    near = P.alike(code[:-1], some[:-1], code[1:], some[1:])
    assert near[0] > 0.95 and near[2] == 1 and near[1] < 0.1 and near[3] < 0.1
    assert P.alike(code[:1], some[:1], *P.codes([long.upper()]))[0] == 1


def test_likeness_is_unbiased():
    pick = random.Random(5)
    errors = []
    for size in (3, 5, 6, 12, 40, 150, 600, 3000):
        for _ in range(40):
            a = [f"w{pick.randrange(10**6)}" for _ in range(size)]
            k = pick.randrange(size + 1)
            b = a[:k] + [f"v{pick.randrange(10**6)}" for _ in range(size - k)]
            x, y = " ".join(a), " ".join(b)
            code, some = P.codes([x, y])
            errors.append((size, P.alike(code[:1], some[:1], code[1:], some[1:])[0] - jaccard(x, y)))
    assert abs(np.mean([e for _, e in errors])) < 0.01
    assert np.abs([e for s, e in errors if s >= 150]).mean() < 0.025 and np.abs([e for s, e in errors if s < 6]).max() < 0.06
    assert np.abs([e for s, e in errors]).max() < 0.25  # few shingles of which each fills many bins


WORDS = "alpha beta gamma delta one two three four five six".split()
TEXTS = ["", None, "a", "ab", " ".join(WORDS), " ".join(WORDS * 9), "é漢字😀 " * 11, " ".join(WORDS * 9), "\n\t ", "x" * 5001, " ".join(f"u{i}" for i in range(400))]


def rows_of(n=60):
    return [(i * 3 - 20, TEXTS[i % len(TEXTS)]) for i in range(n)] + [(7, "tie one"), (7, "tie two"), (7, "tie one"), (None, "no id at all here now"), (None, None), (-20, "before?")]


def test_every_document_meets_the_next(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, fingerprint string, bucket int").repartition(5)
    got = P.edited(docs).collect()
    want = by_hand(rows)
    expected = []
    for d, n, digest, text, changed, after in want:
        code, some = P.codes([text, changed, after])
        near = P.alike(code[[0, 0]], some[[0, 0]], code[1:], some[1:]).tolist()
        expected.append((d, n, digest, *P.packed(code, some)[:2], *near))
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == sorted(expected)
    none = sorted((r["n_chars"], r["edited_sha256"], r["near_next"]) for r in got if r["doc_id"] is None)
    half = hashlib.sha256(b"no id at all here now"[:11]).hexdigest()
    assert none == [(0, hashlib.sha256(b"").hexdigest(), None), (21, half, None)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_documents_and_none(spark, n):
    docs = spark.createDataFrame([(i, f"text number {i} of a few") for i in range(n)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in P.edited(docs).collect())
    assert got == [w[:3] for w in by_hand([(i, f"text number {i} of a few") for i in range(n)])]
    assert P.edited(docs.limit(0)).collect() == []
    assert P.edited(docs.select(docs.doc_id.cast("string").alias("doc_id"), "text")).count() == n


def test_the_columns_of_likeness(spark):
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)], "doc_id long, text string, fingerprint string")
    prints = P.fingerprint(docs)
    assert prints.columns == ["doc_id", "text", "fingerprint"]
    a, b = prints.select("doc_id", "fingerprint"), prints.selectExpr("doc_id + 1 as doc_id", "fingerprint as other")
    for r in a.join(b, "doc_id").select("doc_id", P.likeness("fingerprint", "other").alias("x")).collect():
        i = r["doc_id"]
        code, some = P.codes([TEXTS[i] or "", TEXTS[i - 1] or ""])
        assert r["x"] == pytest.approx(P.alike(code[:1], some[:1], code[1:], some[1:])[0])
