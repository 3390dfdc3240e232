"""Fixpoint loops: each round joins the newest rows only, and is written to the shared folder, which cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROUNDS = 200
#: Rows of a round up to which they are broadcast to what is known; larger rounds are joined by a shuffle.
SMALL = 200_000


def _folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "flowlens-checkpoint")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written under the session's spark.checkpoint.dir (a local folder only where that is unset) and read back."""
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near(rows: DataFrame, small: int = SMALL) -> DataFrame:
    """The rows, to be broadcast where they are few."""
    return F.broadcast(rows) if rows.limit(small + 1).count() <= small else rows


def unseen(rows: DataFrame, known: DataFrame, keys: list[str], small: int = SMALL) -> DataFrame:
    """The rows, each once by its keys, whose keys aren't known. A small round goes to where the known rows are, which then aren't shuffled."""
    new = staged(rows.dropDuplicates(keys))
    if new.limit(small + 1).count() > small:
        return new.join(known.select(*keys), keys, "left_anti").select(*new.columns)
    met = known.select(*keys).join(F.broadcast(new.select(*keys)), keys, "left_semi")  # no more rows than new has
    return new.join(F.broadcast(met), keys, "left_anti").select(*new.columns)


class Rounds:
    """A relation that grows round by round: each round is a folder of one table, so the plan of the whole stays flat."""

    def __init__(self, first: DataFrame):
        self.spark, self.schema, self.n = first.sparkSession, first.schema, 0
        self._all, self._listed = None, -1
        self.base = _folder(self.spark)
        self.newest = self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        path = f"{self.base}/round={self.n}"
        rows.write.parquet(path)
        self.n += 1
        self.newest = self.spark.read.schema(self.schema).parquet(path)
        return self.newest

    def since(self, n: int) -> DataFrame:
        """The rows of round n and later; there must be one."""
        return self.spark.read.schema(self.schema).parquet(*(f"{self.base}/round={i}" for i in range(min(n, self.n - 1), self.n)))

    @property
    def all(self) -> DataFrame:
        if self._listed != self.n:  # files are listed once a round
            self._all, self._listed = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.base), self.n
        return self._all


def grow(first: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str] | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """All rows that first and repeated steps of the newest rows make, each once.

    step gives candidate rows from the newest ones; those whose keys (default: all columns) are known are dropped. Up to SMALL newest
    rows are broadcast to what step joins them with, so that is read, but not shuffled, in each round; step should join what is
    written. Raises if rows are still new after max_rounds.
    """
    keys = keys or first.columns
    known = Rounds(first.dropDuplicates(keys))
    for _ in range(max_rounds):
        if not known.add(unseen(step(near(known.newest)).select(*first.columns), known.all, keys)).take(1):
            return known.all
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")


def reachable(edges: DataFrame, seeds: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """edges: src, dst, read in each round. seeds: seed. Pairs seed, node of everything reachable, the seed included."""
    first = seeds.select("seed", F.col("seed").alias("node")).distinct()
    link = edges.select("src", "dst")
    return grow(first, lambda new: new.join(link, new["node"] == link["src"]).select("seed", F.col("dst").alias("node")), max_rounds=max_rounds)


def least_reaching(edges: DataFrame, start: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """edges: src, dst. start: node, value. For each node the least value among itself and the nodes that reach it."""
    value = Rounds(start.groupBy("node").agg(F.min("value").alias("value")))
    for _ in range(max_rounds):
        new = value.newest
        sent = new.join(edges, new["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("value").alias("value"))
        if not value.add(improved(sent, value.all, ["node"], "value")).take(1):
            return value.all.groupBy("node").agg(F.min("value").alias("value"))
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")


def improved(sent: DataFrame, known: DataFrame, keys: list[str], value: str, unknown: bool = False, small: int = SMALL) -> DataFrame:
    """The rows of sent (keys, value) below the least known value of their keys, and those of unknown keys if wanted. Like `unseen`, small rounds are broadcast."""
    new = staged(sent)
    near = known.join(F.broadcast(new.select(*keys)), keys, "left_semi") if new.limit(small + 1).count() <= small else known
    best = near.groupBy(*keys).agg(F.min(value).alias("known_least"))
    return new.join(best, keys, "left" if unknown else "inner").where(f"known_least is null or {value} < known_least").select(*new.columns)


#: Edges of a graph, or of a component, up to which one task takes it apart.
SMALL_LOOP = 5_000


def _components(edges: set[tuple[str, str]]) -> list[set[str]]:
    """The strongly connected components of two nodes or more."""
    after: dict[str, list[str]] = {}
    for a, b in sorted(edges):
        after.setdefault(a, []).append(b)
    number, low, stack, held, found = {}, {}, [], set(), []
    for start in after:
        if start in number:
            continue
        todo = [(start, iter(after[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        held.add(start)
        while todo:
            at, ways = todo[-1]
            for to in ways:
                if to not in number:
                    number[to] = low[to] = len(number)
                    stack.append(to)
                    held.add(to)
                    todo.append((to, iter(after.get(to, ()))))
                    break
                if to in held:
                    low[at] = min(low[at], number[to])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[at])
                if low[at] == number[at]:
                    part = set()
                    while at not in part:
                        part.add(stack.pop())
                    held -= part
                    if len(part) > 1:
                        found.append(part)
    return found


def _represented(rows):
    """rows: src, dst. node, representative of a small graph."""
    parts = _components(set(zip(rows["src"], rows["dst"])))
    told = {n: min(p) for p in parts for n in p} | {n: n for n in {*rows["src"], *rows["dst"]}.difference(*parts)}
    return rows.iloc[:0].reindex(range(len(told))).assign(node=list(told), representative=list(told.values()))[["node", "representative"]]


def strong_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS, small: int = SMALL_LOOP) -> DataFrame:
    """edges: src, dst (strings). node, representative: the least node of its strongly connected component.

    Colouring: each node takes the least node that reaches it; the nodes of a colour that reach the colour's own node are
    its component; they leave, and the rest goes on. A rest of up to `small` edges is taken apart by one task.
    """
    edge = staged(edges.select("src", "dst").where("src <> dst").distinct())
    left = staged(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    done = None
    for _ in range(max_rounds):
        if edge.limit(small + 1).count() <= small:
            rest = edge.groupBy().applyInPandas(_represented, "node string, representative string")
            alone = left.join(edge.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_anti").select("node", F.col("node").alias("representative"))
            return reduce(DataFrame.unionByName, [d for d in (done, rest, alone) if d is not None])
        colour = least_reaching(edge, left.select("node", F.col("node").alias("value")))
        inside = edge.join(colour.select(F.col("node").alias("src"), F.col("value").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("value").alias("cd")), "dst").where("cs = cd")
        back = staged(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = reachable(back, colour.where("node = value").select(F.col("node").alias("seed"))).select("node", F.col("seed").alias("representative"))
        done = found if done is None else done.unionByName(found)
        left = staged(left.join(found, "node", "left_anti"))
        if not left.take(1):
            return done
        edge = staged(edge.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    raise RuntimeError(f"components left after {max_rounds} rounds")


def _back_edges(rows):
    """rows: of, src, dst of one component; src null marks a node that an edge from outside leads to."""
    outer = set(rows.loc[rows["src"].isna(), "dst"])
    left = {e for e in zip(rows["src"], rows["dst"]) if isinstance(e[0], str)}
    todo, back = left, set()
    while todo:
        nested = set()
        for part in _components(todo):
            inside = {e for e in todo if e[0] in part and e[1] in part}
            entered = {b for a, b in left if b in part and a not in part} | (outer & part)
            entry = min(entered or part)
            out = {e for e in inside if e[1] == entry}
            back, nested = back | out, nested | (inside - out)
        todo, left = nested, left - back
    return rows.iloc[:0][["src", "dst"]].reindex(range(len(back))).assign(src=[a for a, _ in back], dst=[b for _, b in back])


def without_back_edges(edges: DataFrame, max_rounds: int = MAX_ROUNDS, small: int = SMALL_LOOP) -> DataFrame:
    """edges: src, dst (strings). The edges, each once, without loops and without those that lead back in a depth-first walk: no cycle is left.

    An edge leads back within its strongly connected component only. A component's entry is the least of its nodes that an edge
    from outside leads to, or else the least of all; the edges within it to the entry are dropped, and the nested components of what
    is left follow. Where every loop has one entry these are the back edges of any depth-first walk; for loops with several
    entries a walk's result depends on its order, and this is one that doesn't depend on chance. Components of up to `small`
    edges are taken apart by one task each; larger ones a level of nesting in each round.
    """
    left = staged(edges.select("src", "dst").where("src <> dst").distinct())
    todo = left
    for _ in range(max_rounds):
        part = staged(strong_components(todo))
        side = lambda c: part.select(F.col("node").alias(c), F.col("representative").alias(f"of_{c}"))
        told = left.join(side("dst"), "dst").join(side("src"), "src", "left").withColumn("within", F.coalesce(F.col("of_src") == F.col("of_dst"), F.lit(False)))
        size = told.where("within").groupBy("of_dst").count()
        told = staged(told.join(size, "of_dst").select("src", "dst", F.col("of_dst").alias("of"), "within", (F.col("count") <= small).alias("is_small")))
        inside = told.where("within and not is_small")
        marks = told.where("not within").select("of", F.lit(None).cast("string").alias("src"), "dst", "is_small").distinct()
        whole = told.where("within and is_small").select("of", "src", "dst").unionByName(marks.where("is_small").select("of", "src", "dst"))
        back = whole.groupBy("of").applyInPandas(_back_edges, "src string, dst string")
        nodes = inside.select("of", "dst").withColumn("outer", F.lit(1)).unionByName(marks.where("not is_small").select("of", "dst").withColumn("outer", F.lit(0)))
        entry = nodes.groupBy("of").agg(F.min(F.struct("outer", "dst")).alias("e")).select("of", F.col("e.dst").alias("dst"))
        cut = staged(back.unionByName(inside.join(entry, ["of", "dst"], "left_semi").select("src", "dst")))
        left = staged(left.join(cut, ["src", "dst"], "left_anti"))
        todo = staged(inside.select("src", "dst").join(cut, ["src", "dst"], "left_anti"))
        if not todo.take(1):
            return left
    raise RuntimeError(f"cycles left after {max_rounds} rounds")


def _walked(edges: DataFrame, roots: DataFrame, depth: int) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """The edges, each once, and the walks that contexts are: those of fewer than `depth` edges begin at a root, those of `depth` edges at anything reached."""
    if depth < 1:
        raise ValueError("depth must be 1 or more")
    edge = staged(edges.select("caller", "callee").distinct())
    root = staged(roots.select("node").distinct())
    reached = grow(root, lambda new: new.join(edge, new["node"] == edge["caller"]).select(F.col("callee").alias("node")))
    return edge, [*((root, k) for k in range(depth)), (reached, depth)]


def _ambiguous(starts: list[tuple[DataFrame, int]]) -> bool:
    """Whether different lists of names may be joined to the same text."""
    return bool(starts[-1][0].where("node = '' or contains(node, '>')").take(1))


def _contexts(edge: DataFrame, starts: list[tuple[DataFrame, int]]) -> DataFrame:
    def walk(start: DataFrame, k: int) -> DataFrame:
        rows = start.select(F.col("node").alias("fn"), F.lit(None).cast("string").alias("ctx"))
        for _ in range(k):
            rows = rows.join(edge, rows["fn"] == edge["caller"]).select(F.col("callee").alias("fn"), F.concat_ws(">", "ctx", "fn").alias("ctx"))
        return rows.select("fn", F.coalesce("ctx", F.lit("")).alias("ctx"))

    rows = reduce(DataFrame.unionByName, [walk(*x) for x in starts])
    return rows.distinct() if _ambiguous(starts) else rows  # else each once, as nodes and edges are


def bounded_contexts(edges: DataFrame, roots: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """edges: caller, callee. roots: node. Functions with their last `depth` callers (ctx, oldest first): context nodes and edges.

    Only what is reached is searched for in rounds; the contexts are the walks of that many edges to a function, so they are
    joined and neither kept nor compared. depth 0 would be unbounded on recursive graphs and is refused.
    """
    edge, starts = _walked(edges, roots, depth)
    node = _contexts(edge, starts)
    return node, node.join(edge, node["fn"] == edge["caller"]).select("fn", "ctx", "callee")


def bounded_context_totals(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """caller, callee of the edges of `bounded_contexts`, with the number, first, last and summed length of the contexts of each.

    The contexts of an edge are its caller's. Those of k callers are told for each function from those of k - 1 of its callers: no
    text that ends in > begins another one of as many names, so the first and the last stay so whatever is put behind them.
    """
    edge, starts = _walked(edges, roots, depth)
    if _ambiguous(starts):
        told = _contexts(edge, starts).groupBy("fn").agg(F.count("*").alias("contexts"), F.min("ctx").alias("first"), F.max("ctx").alias("last"), F.sum(F.length("ctx")).alias("length"))
    else:
        total = lambda rows, mark: rows.groupBy("to").agg(F.sum("contexts").alias("contexts"), F.min(F.concat("first", "fn", mark)).alias("first"), F.max(F.concat("last", "fn", mark)).alias("last"), F.sum(F.col("length") + F.col("contexts") * F.length(F.concat("fn", mark))).alias("length")).withColumnRenamed("to", "fn")

        def walk(start: DataFrame, k: int) -> DataFrame:
            rows = start.select(F.col("node").alias("fn"), F.lit(1).cast("long").alias("contexts"), F.lit("").alias("first"), F.lit("").alias("last"), F.lit(0).cast("long").alias("length"))
            for i in range(k):
                rows = total(rows.join(edge, rows["fn"] == edge["caller"]).withColumnRenamed("callee", "to"), F.lit(">" if i + 1 < k else ""))
            return rows

        every = reduce(DataFrame.unionByName, [walk(*x) for x in starts])
        told = staged(every.groupBy("fn").agg(F.sum("contexts").alias("contexts"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length")))
    return told.join(edge, told["fn"] == edge["caller"]).select("caller", "callee", "contexts", "first", "last", "length")


def relevant_nodes(copy: DataFrame, probes: DataFrame) -> DataFrame:
    """Nodes from which a probe can be reached over copies: node."""
    back = copy.select("src", F.col("dst").alias("node")).distinct()
    return grow(probes.select("node").distinct(), lambda new: back.join(new, "node").select(F.col("src").alias("node")))


def transitive_targets(pts: DataFrame, probes: DataFrame, functions: DataFrame) -> DataFrame:
    """For each probe the functions among everything that its points-to sets lead to: probe, target."""
    found = reachable(pts.select(F.col("node").alias("src"), F.col("obj").alias("dst")), probes.select(F.col("node").alias("seed")))
    return found.where("seed <> node").join(functions.select(F.col("name").alias("node")), "node", "left_semi").select(F.col("seed").alias("probe"), F.col("node").alias("target"))


def returning_functions(seeds: DataFrame, returns: DataFrame) -> DataFrame:
    """seeds: fn that return pointers. returns: fn, callee of `return callee(...)`. All functions that return pointers."""
    return grow(seeds.select("fn").distinct(), lambda new: returns.join(new.withColumnRenamed("fn", "callee"), "callee").select("fn"))
