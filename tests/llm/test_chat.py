from collections import defaultdict

import duckdb
import pandas as pd

from flowlens.llm import chat


def brute(rows, span=64):
    """(conv, speaker, part) -> (turns, text, masks)."""
    by = defaultdict(set)
    for c, t, role, text in rows:
        if c is not None:
            by[c].add((t, role or "system", (text or "").replace("<|", "< |")))
    out = {}
    for c, turns in by.items():
        for speaker in {r for _, r, _ in turns} - {"system"}:
            parts = defaultdict(list)
            for t, role, text in turns:
                parts[-1 if t is None else t // span].append((t, role, text))
            for part, said in parts.items():
                text, masks = "", []
                for _, role, words in sorted(said, key=lambda x: (x[0] is not None, x)):
                    text += "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user|>\n{role}: "
                    at = len(text)
                    text += words + "<|end|>\n"
                    if role == speaker:
                        masks.append((at, len(text)))
                out[c, speaker, part] = (len(said), text, masks)
    return out


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|end|> bob"), (1, 2, "bob", "ünï 😀"), (1, 3, "cid", None), (1, 3000, "ann", "much later"), (1, 1, "ann", "Hi <|end|> bob"),
    (2, 0, "system", "alone"), (3, None, "ann", "no turn"), (3, 1, None, "no role"), (None, 1, "ann", "no dialogue"), (4, 64, "ann", ""), (4, -1, "bob", "before"),
]


def found(frame):
    return {(r["conv_id"], r["speaker"], r["part"]): (r["n_turns"], r["text"], [(m["s"], m["e"]) for m in r["masks"]]) for r in frame.collect()}


def test_equals_plain_python(spark):
    rows = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, part string")
    got = found(chat.rotate(rows))
    assert got == brute(ROWS)
    for key, (_, text, masks) in got.items():
        assert all(text[e - 8 : e] == "<|end|>\n" and text[:s].endswith("<|assistant|>\n") for s, e in masks), key


def test_crowded_parts_are_split_and_keep_their_rows(spark):
    rows = [(9, t % 3, "ann" if t % 2 else "bob", f"say {t}") for t in range(300)]
    parts = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), max_rows=20).where("speaker = 'ann'").orderBy("part", "sub").collect()
    assert len(parts) > 5 and max(r["n_turns"] for r in parts) < 100 and sum(r["n_turns"] for r in parts) == 300
    whole = "".join(r["text"] for r in parts)
    turns = [int(x.split("<|end|>")[0].split("say ")[1]) % 3 for x in whole.split("<|end|>\n")[:-1]]
    assert turns == sorted(turns)


def test_sql(spark):
    rows = [r for r in ROWS if r[1] is not None]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "role": object, "text": object}))
    want = {(c, s, p): (n, text, ",".join(f"{a}:{b}" for a, b in m)) for (c, s, p), (n, text, m) in brute(rows).items()}
    assert {tuple(r[:3]): tuple(r[3:]) for r in con.sql(chat.OP5_SQL).fetchall()} == want


def test_empty_table(spark):
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_the_query_equals_its_sql_on_ties_null_turns_and_crowded_parts(spark, tmp_path):
    rows = [(*r,) for r in ROWS] + [(5, 7, f"r{k % 3}", f"tie {k * 37 % 11}") for k in range(30)] + [(6, None, "ann", "b"), (6, None, "ann", "a"), (6, -1, "bob", "c")]
    for conv, turn in ((7, 3), (8, None)):
        rows += [(conv, turn, "bob" if k % 2 else "ann", f"{k * 7919 % 5003}") for k in range(chat.MAX_ROWS + 900)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = chat.op5(spark, str(tmp_path))
    want = con.sql(chat.OP5_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_crowded_parts_give_the_same_when_put_together(spark):
    rows = spark.createDataFrame([(9, t % 5 - 1 or None, "ann" if t % 2 else "bob", f"say {t}") for t in range(300)], "conv_id long, turn long, role string, text string")
    small, large = (sorted(map(tuple, chat.joined(chat.rotate(rows, max_rows=n)).collect())) for n in (20, 4096))
    assert small == large and len(small) == 4
