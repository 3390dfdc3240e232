import binascii
import hashlib
import itertools
import random
import re

import brute
import duckdb
import pytest

from flowlens.llm import repair as R

RIGHT = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    """conv_id -> (turn, role, text) in order, of rows of any conversation."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        code = binascii.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        mine += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], brute.sha(r[2]))) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def counts(rows):
    found, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal


def every_script(rows, most_inserts):
    """(cost, audit, repaired lines) of each way to edit, with up to most_inserts inserts in each gap."""
    choices = []
    for (_, role, text), fault in zip(rows, faults(rows)):
        inserts = [x for n in range(most_inserts + 1) for x in itertools.product(("user", "assistant"), repeat=n)]
        cut = 3 * (fault == "truncated")
        edits = [(4, "D", None)] + ([] if fault in ("blank", "duplicate") else [(cut, "K", (role, text)), *((3 + cut, "R", (r, text)) for r in ("user", "assistant"))])
        choices += [[(3 * len(i), "I" * len(i), [(r, "") for r in i]) for i in inserts], [(c, k, [said] if said else []) for c, k, said in edits]]
    choices.append([(3 * len(i), "I" * len(i), [(r, "") for r in i]) for n in range(most_inserts + 1) for i in itertools.product(("user", "assistant"), repeat=n)])
    for picked in itertools.product(*choices):
        said = [x for p in picked for x in p[2]]
        if RIGHT.match("".join(r[:1] or "-" for r, _ in said)):
            yield sum(p[0] for p in picked), "".join(p[1] for p in picked), "\n".join(f"{r}:{t}" for r, t in said)


def cheapest(rows):
    """The same for longer conversations, turn by turn."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(3):
            for state, (c, a, said) in list(best.items()):
                for r in ("user", "assistant"):
                    if to := step.get((state, r[0])):
                        best[to] = min(best.get(to, (10**9,)), (c + 3, a + "I", said + ((r, ""),)))
        return best

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults(rows)):
        best, now = inserted(best), {}
        for state, (c, a, said) in best.items():
            ways = [(state, (c + 4, a + "D", said))]
            if fault not in ("blank", "duplicate"):
                cut = 3 * (fault == "truncated")
                ways += [(step[state, x], (c + cost + cut, a + k, said + ((r, text),))) for x, cost, k, r in ((role[:1], 0, "K", role), ("u", 3, "R", "user"), ("a", 3, "R", "assistant")) if (state, x) in step]
            for to, way in ways:
                now[to] = min(now.get(to, (10**9,)), way)
        best = now
    c, a, said = min(v for k, v in inserted(best).items() if k in ("", "a"))
    return c, a, "\n".join(f"{r}:{t}" for r, t in said)


def expected(rows):
    out = []
    for conv, mine in damaged(rows).items():
        cost, audit, text = cheapest(mine)
        out.append((conv, *counts(mine), cost, audit, brute.sha(text)))
    return sorted(out, key=str)


def made(seed, convs, longest, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None), texts=("Hi.", "What?", "no end", "", " \n", "Ends. \t", None, "é 漢!", "x.y")):
    pick = random.Random(seed)
    rows = []
    for c in convs:
        for i in range(pick.randrange(1, longest + 1)):
            rows.append((c, None if pick.random() < 0.05 else i if pick.random() < 0.8 else pick.randrange(longest), pick.choice(roles), pick.choice(texts)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, audit string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def test_the_plain_version_is_the_least_of_all_scripts():
    for mine in damaged(made(1, range(60), 3)).values():
        if len(mine) <= 3:
            assert cheapest(mine) == min(every_script(mine, 2))


def test_matrices_in_any_grouping_give_the_cheapest_edits():
    pick = random.Random(2)
    for mine in damaged(made(3, range(40), 14)).values():
        found = faults(mine)
        ms = [R.turn(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(mine, found)]
        while len(ms) > 1:
            i = pick.randrange(len(ms) - 1)
            ms[i : i + 2] = [R.times(ms[i], ms[i + 1])]
        assert R.best(ms[0] if ms else R.ONE) == cheapest(mine)[:2]


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_plain_python(spark, partitions):
    rows = made(4, [*range(30), None], 12) + made(5, [50], 300) + [(60, None, None, None), (61, 1, "user", "Hi."), (61, 1, "user", "Hi."), (61, 2, "user", "Hi.")]
    rows += [(70, 2, "user", "same.")] * 40 + [(70, k, "assistant", "again.") for k in range(60)]
    got = R.repair(frame(spark, rows), partitions).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_a_long_conversation_lies_in_many_partitions(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k}." if k % 5 else f"cut {k}") for k in range(20_000)] + [(0, 0, "user", "Hi."), (2, 0, "user", "Hi.")]
    got = sorted(map(tuple, R.repair(frame(spark, rows), 20).collect()))
    assert [g[0] for g in got] == [0, 1, 2]
    mine = damaged(rows)[1]
    fold = R.Fold()
    for (t, role, _), f in zip(mine, faults(mine)):
        fold.add_row(t, role, 1, f == "blank", f == "duplicate", f == "truncated")
    assert got[1][1:8] == (*counts(mine), *R.best(fold.total()))
    step, state, at, said = {"": "u", "u": "a", "a": "u"}, "", 0, []
    for edit in got[1][7]:
        role = {"u": "user", "a": "assistant"}[step[state]]
        if edit == "I":
            said.append(f"{role}:")
        else:
            if edit != "D":
                said.append(f"{role if edit == 'R' else mine[at][1]}:{mine[at][2]}")
            at += 1
        if edit != "D":
            state = step[state]
            assert edit == "I" or said[-1][0] == state
    assert at == len(mine) and state == "a" and got[1][8] == hashlib.sha256("\n".join(said).encode()).hexdigest()


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "?"), (1, 1, "assistant", " " * 1_000_000), (1, 2, "assistant", "x" * 1_000_000), (1, 3, "user", "x" * 1_000_000)]
    assert sorted(map(tuple, R.repair(frame(spark, rows)).collect())) == expected(rows)


def test_the_query_equals_its_sql(spark, tmp_path):
    rows = made(6, [*range(25), None], 10)
    frame(spark, rows).drop("audit", "n").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    out, want = R.op11(spark, str(tmp_path)), con.sql(R.OP11_SQL)
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want.fetchall(), key=str) == expected(rows)


def test_empty_tables(spark):
    assert R.repair(frame(spark, [(1, 1, "user", "x")]).limit(0)).collect() == []
    none = [(c, t, "user", "Hi.") for c in range(40) for t in range(40) if binascii.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    assert sorted(map(tuple, R.repair(frame(spark, none)).collect())) == sorted({(c, 0, 0, 0, 0, 0, 0, "", brute.sha("")) for c, *_ in none})
