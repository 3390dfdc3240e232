r"""Conversation structure repair by a min-plus matrix scan.

A conversation is right if the initials of its roles read `(s?(ua)+)?`. Edits: keep a turn (0), give it the role user or
assistant (R, 3), delete it (D, 4; blank and duplicate turns must go), insert a turn of empty text (I, 3); a truncated turn that
stays costs 3 more. The cheapest edits are looked for, of equal ones the ASCII-least string of their initials (K, R, D, I).

The pattern has four states: nothing yet, after s, after u, after a. A turn is a 4x4 matrix whose entry (p, q) is the least
(cost, audit) that leads from p to q, inserts before the turn included; the product takes the least of the sums, where costs add
and audits are joined. It's associative: turns are sorted by range partitions, each partition folds each conversation's run of
turns to one matrix, and the matrices of a conversation that lies in several partitions are folded FAN at a time. Folding keeps one
matrix for each power of two, and n copies of a turn are a power of its matrix.

Only digests of texts are sorted and folded; the texts move once, to be written behind their conversation's audit. A SHA-256 is
sequential, so one task streams a conversation's texts through it, whatever their number, and holds one row at a time.

Defined results: a null role or text is one space; null turns come first; rows of one turn are in the order of role and of the text's
SHA-256, identical ones side by side, and count one by one; rows with a null conv_id are one conversation; roles count by their
first character; conversations of which no row is left have zeros, an empty audit and the hash of nothing; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowlens.llm.common import staged, table

RETAG, DELETE, INSERT, CUT = 3, 4, 3, 3
START, S, U, A = range(4)
#: Where each state goes on an initial; the pattern may end in START and A.
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
FAN = 8

Element = tuple[int, str]
Matrix = list[Element | None]  # row by row


def plus(a: Matrix, b: Matrix) -> Matrix:
    return [y if x is None else x if y is None else min(x, y) for x, y in zip(a, b)]


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for p in range(0, 16, 4):
        ways = [(a[p + k], 4 * k) for k in range(4) if a[p + k] is not None]
        for q in range(4):
            found = [(x[0] + y[0], x[1], y[1]) for x, k in ways if (y := b[k + q]) is not None]
            if not found:
                out.append(None)
                continue
            least = min(f[0] for f in found)
            texts = [f[1] + f[2] for f in found if f[0] == least]
            out.append((least, min(texts)))
    return out


def power(m: Matrix, n: int) -> Matrix:
    out = None
    while n:
        if n & 1:
            out = m if out is None else times(out, m)
        m, n = times(m, m) if n > 1 else m, n >> 1
    return out if out is not None else ONE


def _matrix(steps: dict[tuple[int, int], Element]) -> Matrix:
    return [steps.get((p, q)) for p in range(4) for q in range(4)]


ONE = _matrix({(p, p): (0, "") for p in range(4)})


def closure(m: Matrix) -> Matrix:
    """Any number of m, one after the other; costs are positive, so three of them reach all that four states can."""
    return plus(ONE, times(m, plus(ONE, times(m, plus(ONE, m)))))


INSERTS = closure(_matrix({(p, q): (INSERT, "I") for (p, x), q in NEXT.items() if x in ROLES}))


@lru_cache(maxsize=256)
def _turn(initial: str, goes: bool, cut: bool) -> tuple[Element | None, ...]:
    steps = {(p, p): (DELETE, "D") for p in range(4)}
    if not goes:
        stays = CUT if cut else 0
        for (p, x), q in NEXT.items():
            if x == initial:
                steps[p, q] = (stays, "K")
            elif x in ROLES:
                steps[p, q] = (RETAG + stays, "R")
    return tuple(times(INSERTS, _matrix(steps)))


def turn(initial: str, goes: bool, cut: bool) -> Matrix:
    """The matrix of a turn with the inserts before it. goes: it has to be deleted."""
    return list(_turn(initial if initial in "sua" else "", goes, cut))


def best(m: Matrix) -> Element:
    """The least element of a whole conversation, inserts at its end included."""
    last = times(m, INSERTS)
    return min(x for x in (last[START], last[A]) if x is not None)


class Fold:
    """A run of turns: its counts, and its matrices, one for each power of two."""

    def __init__(self):
        self.counts = [0] * 4  # blank, duplicate, truncated, illegal
        self.turns = [None, None, 0]  # lowest, highest, number of different ones
        self.ends = [None, None]  # first and last initial
        self.stack: list[tuple[int, Matrix]] = []

    def push(self, m: Matrix, rank: int = 0):
        while self.stack and self.stack[-1][0] <= rank:
            before, first = self.stack.pop()
            m, rank = times(first, m), max(before, rank) + 1
        self.stack.append((rank, m))

    def add(self, counts, turns, ends, m: Matrix, rank: int = 0):
        """A run that follows; counts and turns are its own."""
        self.counts = [x + y for x, y in zip(self.counts, counts)]
        if ends[0] is not None:
            if self.ends[1] is not None:
                self.counts[3] += self.ends[1] + ends[0] not in ("su", "ua", "au")
            self.ends = [ends[0] if self.ends[0] is None else self.ends[0], ends[1]]
        if turns[2]:
            same = self.turns[2] and self.turns[1] == turns[0]
            self.turns = [self.turns[0] if self.turns[2] else turns[0], turns[1], self.turns[2] + turns[2] - bool(same)]
        self.push(m, rank)

    def add_row(self, at: int | None, role: str, n: int, blank: bool, earlier: bool, cut: bool):
        """n copies of a row (0: a dropped one). earlier: its role and text stood at an earlier turn."""
        if not n:
            return self.push(ONE)
        initial, gone = role[:1], blank or earlier
        m = turn(initial, gone, cut)
        if n > 1:
            m = times(m, power(turn(initial, True, cut), n - 1))
        counts = [n if blank else 0, 0 if blank else n if earlier else n - 1, int(cut and not gone), n - 1]
        return self.add(counts, [at, at, int(at is not None)], [initial, initial], m)

    def total(self) -> Matrix:
        out = None
        for _, m in self.stack:
            out = m if out is None else times(out, m)
        return ONE if out is None else out


_PIECE = [("counts", T.ArrayType(T.LongType())), ("turns", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.StringType())), ("costs", T.ArrayType(T.LongType())), ("audits", T.ArrayType(T.StringType()))]
_FIRST = [("turn", T.LongType()), ("role", T.StringType()), ("digest", T.StringType())]
_FOUND = [*((n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", T.StringType())]


def _fields(kind: T.DataType, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *(T.StructField(n, t) for n, t in more)])


def _written(fold: Fold) -> tuple:
    m = fold.total()
    return fold.counts, fold.turns, fold.ends, [x and x[0] for x in m], [x and x[1] for x in m]


def _read(counts, turns, ends, costs, audits) -> tuple:
    return counts, turns, ends, [None if c is None else (c, a) for c, a in zip(costs, audits)]


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, schema)], names=schema.names)


#: Rows that leave a task together, and characters of their audits.
_ROWS, _CHARS = 2000, 1 << 20


def _in_batches(rows, schema: T.StructType, weight):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= _ROWS or size >= _CHARS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def damage(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. The rows with copies, how often each stands after the damage (0, 1, 2), and role and text as they are then."""
    told = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    told = told.withColumn("code", F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20)
    return told.select(
        "conv_id", "turn", F.expr("if(code = 4, 'user', role)").alias("role"), F.expr("case code when 1 then '' when 2 then translate(text, '.!?', '') else text end").alias("text"),
        F.expr("case code when 0 then 0L when 3 then 2L else 1L end").alias("copies"),
    )


def _faults(rows: DataFrame) -> DataFrame:
    """rows with copies. One row for all alike: conv_id, turn, role, digest, n, blank, earlier, cut; dropped rows are one with n 0 for each conversation."""
    kept = F.col("copies") > 0
    told = rows.withColumn("end", F.rtrim("text", F.lit(BLANKS)))
    told = told.select(
        "conv_id", F.when(kept, F.col("turn")).alias("turn"), F.when(kept, F.col("role")).otherwise("").alias("role"), F.when(kept, F.sha2("text", 256)).otherwise("").alias("digest"), "copies",
        (kept & (F.col("end") == "")).alias("blank"), (kept & ~F.substring("end", -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    alike = told.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").alias("n"))
    # role and text at several turns: rare, and joined to the rows
    again = alike.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("t"))).alias("first"), F.count("*").alias("times")).where("times > 1")
    same = alike["conv_id"].eqNullSafe(F.col("c")) & (alike["role"] == F.col("r")) & (alike["digest"] == F.col("d"))
    return alike.join(again, same, "left").select("conv_id", "turn", "role", "digest", "n", "blank", F.expr("first is not null and not (first.t <=> turn)").alias("earlier"), "cut")


def _folded(kind: T.DataType, schema: T.StructType):
    names = ["conv_id", "turn", "role", "digest", "n", "blank", "earlier", "cut"]

    def runs(batches):
        fold = now = first = None
        for b in batches:
            for c, at, role, digest, n, blank, earlier, cut in zip(*(b[name].to_pylist() for name in names)):
                if fold is None or c != now:
                    if fold is not None:
                        yield (now, *first, *_written(fold))
                    fold, now, first = Fold(), c, (at, role, digest)
                fold.add_row(at, role, n, blank, earlier, cut)
        if fold is not None:
            yield (now, *first, *_written(fold))

    return lambda batches: _in_batches(runs(batches), schema, lambda row: sum(len(a) for a in row[-1] if a))


def _merge(kind: T.DataType, schema: T.StructType):
    def work(key, table):
        fold = Fold()
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        for r in rows:
            fold.add(*_read(*(r[n] for n, _ in _PIECE)))
        return pa.Table.from_batches([_batch([(key[0].as_py(), key[1].as_py(), *_written(fold))], schema)])

    return work


def fold(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """rows: a frame of `damage`. Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    kind, spark = rows.schema["conv_id"].dataType, rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "digest"]
    schema = _fields(kind, *_FIRST, *_PIECE)
    runs = _faults(rows).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_folded(kind, schema), schema)
    place = Window.partitionBy("conv_id")  # a row for each partition that a conversation reaches
    runs = staged(runs.withColumns({"piece": F.row_number().over(place.orderBy(*order[1:])).cast("long") - 1, "pieces": F.count("*").over(place)}))
    whole, parts = runs.where("pieces = 1"), runs.where("pieces > 1").select("conv_id", "piece", *(n for n, _ in _PIECE))
    most = runs.agg(F.max("pieces")).first()[0] or 1
    schema = _fields(kind, ("piece", T.LongType()), *_PIECE)
    while most > 1:
        to = parts.withColumn("to", F.expr(f"piece div {FAN}"))
        parts, most = to.groupBy("conv_id", "to").applyInArrow(_merge(kind, schema), schema), -(-most // FAN)
    names = [n for n, _ in _PIECE]
    found = _fields(kind, *_FOUND)

    def results(batches):
        for b in batches:
            for c, *piece in zip(b["conv_id"].to_pylist(), *(b[n].to_pylist() for n in names)):
                counts, (low, high, different), _, m = _read(*piece)
                cost, audit = best(m)
                yield (c, high - low + 1 - different if different else 0, *counts, cost, audit)

    return whole.select("conv_id", *names).unionByName(parts.select("conv_id", *names)).mapInArrow(lambda batches: _in_batches(results(batches), found, lambda row: len(row[-1])), found)


class _Writer:
    """The repaired conversation, edit by edit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines = audit, 0, START, 0
        self.digest = hashlib.sha256()

    def line(self, role: str, text: str):
        self.digest.update(("\n" * (self.lines > 0) + role + ":").encode())
        self.digest.update(text.encode("utf-8", "surrogatepass"))
        self.lines, self.state = self.lines + 1, NEXT[self.state, role[:1]]

    def inserts(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.line(self.role(), "")
            self.at += 1

    def role(self) -> str:
        return ROLES["a" if self.state == U else "u"]

    def row(self, role: str, text: str):
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            self.line(role if edit == "K" else self.role(), text)


def repair(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """turns: conv_id, turn, role, text. Damages and repairs them; the columns of op11's contract."""
    rows = damage(turns)
    kind = rows.schema["conv_id"].dataType
    heads = fold(rows, partitions).withColumn("copies", F.lit(-1).cast("long"))
    texts = rows.where("copies > 0").withColumn("digest", F.sha2("text", 256))
    both = heads.unionByName(texts, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("copies") > 0, "turn", "role", "digest")
    schema = _fields(kind, *_FOUND, ("repaired_sha256", T.StringType()))
    names = ["conv_id", *(n for n, _ in _FOUND)]

    def repaired(batches):
        head = writer = None
        for b in batches:
            kinds = b["copies"].to_pylist()
            found = [b[n].to_pylist() for n in names]
            for i, (copies, role, text) in enumerate(zip(kinds, b["role"].to_pylist(), b["text"].to_pylist())):
                if copies < 0:
                    if head:
                        writer.inserts()
                        yield (*head, writer.digest.hexdigest())
                    head = tuple(column[i] for column in found)
                    writer = _Writer(head[-1])
                else:
                    for _ in range(copies):
                        writer.row(role, text)
        if head:
            writer.inserts()
            yield (*head, writer.digest.hexdigest())

    return both.mapInArrow(lambda batches: _in_batches(repaired(batches), schema, lambda row: len(row[-2])), schema)


def op11(spark, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def _sql() -> str:
    """The same by a recursion over turns: for each conversation the least (cost, audit, text so far) of each state."""
    spaces = r"\x20\x09-\x0D"
    then = lambda s, cost, edit, role, text: f"CASE WHEN {s} IS NOT NULL THEN struct_pack(c := {s}.c + {cost}, a := {s}.a || '{edit}', t := CASE WHEN {s}.t IS NULL THEN '' ELSE {s}.t || chr(10) END || {role} || ':' || {text}) END"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    add = lambda s, role: then(s, INSERT, "I", f"'{role}'", "''")
    closed = f"""SELECT * EXCLUDE (u, a), {least('u', add('a', 'user'))} AS u, {least('a', add('u', 'assistant'))} AS a
      FROM (SELECT * EXCLUDE (u, a), {least('u', add('o', 'user'), add('s', 'user'), add('a', 'user'))} AS u, {least('a', add('u', 'assistant'))} AS a FROM {{}})"""
    gone = lambda s: f"CASE WHEN {s} IS NOT NULL THEN struct_pack(c := {s}.c + {DELETE}, a := {s}.a || 'D', t := {s}.t) END"
    stays, cut = "fault IS DISTINCT FROM 'blank' AND fault IS DISTINCT FROM 'duplicate'", f"CASE WHEN fault = 'truncated' THEN {CUT} ELSE 0 END"
    if_ = lambda when, way: f"CASE WHEN {when} AND {stays} THEN {way} END"
    keep = lambda s, x: if_(f"x = '{x}'", then(s, cut, "K", "role", "text"))
    tag = lambda s, role: if_("true", then(s, f"{RETAG} + {cut}", "R", f"'{role}'", "text"))
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
b AS (SELECT *, flatten(list_transform(string_split(key, ''), lambda c: list_transform(range(8), lambda i: CAST((ascii(c) >> i) & 1 AS BIGINT)))) AS bits FROM k),
h AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bits), lambda p, q: xor(p >> 1, CASE WHEN (p & 1) <> q THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS code FROM b),
d AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, left(role, 1) AS x FROM n),
f AS (
  SELECT conv_id, turn, role, text, i, x, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^{spaces}]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][{spaces}]*\z') THEN 'truncated' END AS fault FROM m),
g AS (
  SELECT c.conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, count(i) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON c.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY c.conv_id),
r AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, struct_pack(c := CAST(0 AS BIGINT), a := '', t := CAST(NULL AS VARCHAR)) AS o, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS u, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS a FROM g
  UNION ALL
  SELECT r.conv_id, f.i, {gone('r.o')}, {least(gone('r.s'), keep('r.o', 's'))},
    {least(gone('r.u'), *(w for p in ('r.o', 'r.s', 'r.a') for w in (keep(p, 'u'), tag(p, 'user'))))}, {least(gone('r.a'), keep('r.u', 'a'), tag('r.u', 'assistant'))}
  FROM ({closed.format('r')}) r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i + 1),
e AS (SELECT conv_id, i, {least('o', 'a')} AS e FROM ({closed.format('r')}))
SELECT g.conv_id, gaps, blank, duplicate, truncated, illegal, e.c AS cost, e.a AS audit, sha256(coalesce(e.t, '')) AS repaired_sha256
FROM g JOIN e ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.n = e.i
"""


OP11_SQL = _sql()
