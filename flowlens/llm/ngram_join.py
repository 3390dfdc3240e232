r"""N-gram Jaccard join by adaptive multi-match prefixes, and the groups that its links make.

Words are `[^\x20\x09-\x0D]+` of the text with A-Z lowered; a document's set holds its distinct 5-word shingles as 64-bit
hashes (fewer words: the whole sequence as one). Two sets link at 100 * |both| >= 80 * |either|.

1. `summaries`: a 64-bit digest, the node, stands for each set: equal sets are one node however many copies there are.
   Tokens met twice in a batch are counted; the HINTS most frequent ones order the tokens (rare first) and tell costs.
   They are hints: any order gives the same links.
2. `emit`: the tokens of each node's prefix, |x| - ceil(0.8 |x|) + l of them. l grows with the estimated number of
   candidates; a pair must share min(l, l') tokens of the prefixes of that length. Prefixes meet by token; tokens that
   only one node has are dropped, and a token's nodes are parted where their sizes are too far apart to link. The smallest
   node of such a run leads it, a node's lead is its smallest leader.
3. `match`: nodes whose sketches allow no link in their lead's group leave it; the sets of the others meet (large groups in chunks of CHUNK tokens). With d(x) the number of tokens that x
   and the lead don't share, d(x) + d(y) bounds the difference of x and y: nodes near enough to the most central one link
   to it without being compared; each other node is compared with all of its group. Chunks exchange the nodes that are
   not in their group's main component.
4. Pairs of different leads that share tokens enough, and whose sketches allow a link, are verified one by one.
5. Components over the links; all copies of a node get its component.

Bit i of a sketch is the parity of the tokens that fall on it, so two sketches differ in no more bits than the sets in tokens.
No pair inside a component that is already known is made, and no link between components is lost.

Defined results: null or wordless text has 0 shingles and is its own component; a null doc_id takes no part in links and
has a null component; repeated rows and ids are kept; other columns are ignored; an empty table gives no rows. doc_id must be
an integer or cast to one (a text id that isn't a number raises). Texts of any length are taken whole.
Hashes of 64 bits: two different shingles of a pair of documents agree with a probability under 1e-9. Of N different texts
two have the same digest with a probability of N * N / 2^65, and are then taken for copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import staged, table
from flowlens.llm.components import connected

SHINGLE = 5
PERCENT = 80
#: Frequent tokens whose counts order the prefixes: a bounded broadcast of 12 bytes each.
HINTS = 1 << 18
#: Candidates of a node, by the hints, from which its prefix is lengthened: one more token with each doubling.
COST = 64
MAX_MATCHES = 12
#: A hinted token of more nodes than this is dealt to several tasks.
SPLIT = 20_000
#: Tokens of the sets that one task compares with each other.
CHUNK = 2_000_000
#: Rows of a group up to which sketches are compared before sets are fetched; larger groups fetch all.
GROUP = 8192
#: Rows up to which a side of (doc_id, node, lead) or (node, node) is broadcast; larger ones are joined by a shuffle.
SMALL = 200_000
#: Text, or set, bytes that a worker handles at once.
SLICE_BYTES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _plain(texts: pa.Array) -> pa.Array:
    """A-Z lowered and every separator a space, on the bytes."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets, data = texts.buffers()[1:]
    if data is None or not data.size:
        return texts
    raw = np.frombuffer(data, np.uint8).copy()
    raw[(raw >= 9) & (raw <= 13)] = 32
    raw[(raw >= 65) & (raw <= 90)] += 32
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(raw), offset=texts.offset)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted, and the number of them for each row."""
    k = len(texts)
    lists = pc.split_pattern(_plain(texts), " ")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    row = np.repeat(np.arange(k), np.diff(offsets))
    h = hashes[coded.indices.to_numpy(zero_copy_only=False)]
    full = (words != "")[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, bool)
    row, h = row[full], h[full]
    per = np.bincount(row, minlength=k)
    starts = np.cumsum(per) - per

    def joined(at: np.ndarray, length: int) -> np.ndarray:
        out = np.full(len(at), length, np.uint64) * _MIX
        for i in range(length):
            out = _mixed(out ^ h[at + i]) + _MIX
        return out

    at = np.arange(max(0, len(h) - size + 1))
    at = at[row[at] == row[at + size - 1]] if len(at) else at
    rows, found = [row[at]], [joined(at, size)]
    for length in range(1, size):
        few = np.flatnonzero(per == length)
        rows.append(few)
        found.append(joined(starts[few], length))
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    if len(rows):
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])])
        rows, found = rows[new], found[new]
    return rows, found, np.bincount(rows, minlength=k)


def digests(rows: np.ndarray, found: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row's set, as int64."""
    out = n.astype(np.uint64) * _MIX
    full = np.flatnonzero(n)
    if len(full):
        starts = (np.cumsum(n) - n)[full]
        out[full] = _mixed(out[full] ^ np.add.reduceat(_mixed(found), starts)) ^ np.bitwise_xor.reduceat(_mixed(found + _MIX), starts)
    return out.view(np.int64)


def sketches(rows: np.ndarray, found: np.ndarray, n: np.ndarray, which: np.ndarray) -> pa.Array:
    """For the rows of the mask which, the parities of their tokens on 2n bits or more, a power of two; null for the others."""
    bits = np.where(which, 64 << np.ceil(np.log2(np.maximum(n / 32, 1))).astype(np.int64), 0)
    ends = np.cumsum(bits)
    mine = which[rows]
    at = (ends - bits)[rows[mine]] + (found[mine] & (bits[rows[mine]] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(bool))
    offsets = pa.array(np.concatenate([[0], ends // 8]), pa.int32())
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [pa.array(which, pa.bool_()).buffers()[1], offsets.buffers()[1], pa.py_buffer(raw)])


def differing_bits(a: bytes, b: bytes) -> int:
    """The number of bits in which two sketches differ, the longer one folded."""
    if len(a) < len(b):
        a, b = b, a
    x, y, size = int.from_bytes(a), int.from_bytes(b), 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ y).bit_count()


def _slices(batch: pa.RecordBatch):
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def _once(ids: pa.Array, node: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first row of each node, of those with an id and a shingle, as a mask."""
    good = np.flatnonzero((n > 0) & ids.is_valid().to_numpy(zero_copy_only=False))
    keep = np.zeros(len(n), bool)
    keep[good[np.unique(node[good], return_index=True)[1]]] = True
    return keep


def _summarise(batches):
    for batch in batches:
        for part in _slices(batch):
            rows, found, n = shingle_sets(part["text"])
            node = digests(rows, found, n)
            one = _once(part["doc_id"], node, n)
            tokens, df = np.unique(found[one[rows]], return_counts=True)
            tokens, df = tokens[df > 1].view(np.int64), df[df > 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([False, True], [len(n), len(df)])), pa.concat_arrays([part["doc_id"].cast(pa.int64()), pa.array(tokens)]),
                    pa.concat_arrays([part["h"].cast(pa.int64()), pa.nulls(len(df), pa.int64())]),
                    pa.array(np.concatenate([node, np.zeros(len(df), np.int64)])), pa.array(np.concatenate([n, df]).astype(np.int64)),
                    pa.concat_arrays([sketches(rows, found, n, one), pa.nulls(len(df), pa.binary())]),
                ],
                names=["is_token", "id", "h", "node", "n", "sketch"],
            )


def least_common(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _emitter(hints, percent: int, cost_unit: int, max_matches: int, split: int):
    def emit(batches):
        known, counts = hints.value
        for batch in batches:
            for part in _slices(batch):
                rows, found, n = shingle_sets(part["text"])
                node = digests(rows, found, n)
                one = _once(part["doc_id"], node, n)
                rows, found = rows[one[rows]], found[one[rows]].view(np.int64)
                if not len(rows):
                    continue
                df = np.zeros(len(found), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    df = np.where(known[at] == found, counts[at], 0)
                order = np.lexsort((found, df, rows))
                rows, found, df = rows[order], found[order], df[order]
                size = np.where(one, n, 0)
                place = np.arange(len(rows)) - (np.cumsum(size) - size)[rows]
                common = least_common(size, percent)
                prefix = size - common + 1
                cost = np.bincount(rows, np.where(place < prefix[rows], np.maximum(df - 1, 0), 0), len(size))
                matches = 1 + np.floor(np.log2(np.maximum(cost / cost_unit, 1))).astype(np.int64)
                matches = np.clip(np.minimum(matches, common), 1, max_matches)
                keep = place < (prefix + matches - 1)[rows]
                rows, found, df, place = rows[keep], found[keep], df[keep], place[keep]
                level = np.maximum(place - prefix[rows] + 2, 1)
                deals = np.minimum(-(-df // split), 255)
                salt = np.where(df > split, 1 + (node[rows].view(np.uint64) >> np.uint64(40)).astype(np.int64) % np.maximum(deals, 1), 0)
                info = size[rows] << 24 | level << 16 | matches[rows] << 8 | salt
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(node[rows]), pa.array(info)], names=["token", "node", "info"])

    return emit


def _bucketer(percent: int):
    def buckets(batches):
        """Rows sorted by token, size and node: parts a token's rows where sizes are too far apart to link, drops repeats and rows that are alone in their run, adds the run (its first size; -1 for dealt tokens, whose rows all stay)."""
        token, last, far, run, held = None, None, 0, 0, None
        names = ["token", "node", "info", "run"]
        for batch in batches:
            t, v, i = (batch[c].to_numpy() for c in ("token", "node", "info"))
            if not len(t):
                continue
            if held is not None:
                t, v, i = np.concatenate([[held[0]], t]), np.concatenate([[held[1]], v]), np.concatenate([[held[2]], i])
            new = np.concatenate([[held is not None or t[0] != token or v[0] != last], (t[1:] != t[:-1]) | (v[1:] != v[:-1])])
            t, v, i = t[new], v[new], i[new]
            if not len(t):
                continue
            n = i >> 24
            go_on = held is None and t[0] == token and 100 * far >= percent * n[0]
            first = np.concatenate([[not go_on], (t[1:] != t[:-1]) | (100 * n[:-1] < percent * n[1:])])
            group = np.cumsum(first) - (0 if go_on else 1)
            sizes = np.bincount(group)
            runs = np.concatenate([[run] if go_on else [], n[first]])[group].astype(np.int64)
            dealt = i & 255 > 0
            keep = (sizes[group] > 1) | dealt | ((group == 0) & go_on)
            token, last, far, run, held = t[-1], v[-1], n[-1], runs[-1], None
            if not keep[-1]:  # the rows to come may belong to it
                held = (t[-1], v[-1], i[-1])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (t, v, i, np.where(dealt, -1, runs))], names=names)

    return buckets


def _fetch(batches):
    """The set of each wanted node, from the text of one of its documents, once for each of its places."""
    for batch in batches:
        for part in _slices(batch):
            rows, found, n = shingle_sets(part["text"])
            node = digests(rows, found, n)
            good = np.flatnonzero(node == part["node"].to_numpy())
            ends = np.cumsum(n) * 8
            raw = found.tobytes()
            out, held = [], 0
            for r in good:
                tokens = raw[ends[r] - n[r] * 8 : ends[r]]
                for place in part["places"][int(r)].as_py():
                    out.append((place["lead"], place["chunk"], node[r], place["asks"], tokens))
                    held += len(tokens)
                    if held > SLICE_BYTES:
                        yield _placed(out)
                        out, held = [], 0
            if out:
                yield _placed(out)


def _placed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lead", "chunk", "node", "asks", "tokens"])


def local_components(node: np.ndarray, sets: list[np.ndarray], first: int, percent: int, asks: np.ndarray | None = None) -> np.ndarray:
    """For each set the index that stands for its component among the given sets.

    first: the set from which distances are taken at the start. asks: which sets may need comparing (default all): the
    others are known to be linked with each other.
    """
    k = len(sets)
    label = np.arange(k)
    if asks is not None:
        label[~asks] = np.flatnonzero(~asks)[0] if (~asks).any() else 0
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(k), n)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def pivot(p: int) -> None:
        mine = sets[p]
        a, b = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        lengths = b - a
        at = np.repeat(a - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        both = np.bincount(owner[at], minlength=k)
        off = (100 + percent) * (n + n[p] - 2 * both) - (100 - percent) * n
        centre = int(np.argmin(off))
        near = off + off[centre] <= 0
        near[centre] |= near.any()
        direct = 100 * both >= percent * (n + n[p] - both)
        for group in (near, direct):
            if group.sum() > 1:
                label[np.isin(label, np.unique(label[group]))] = label[group].min()

    fixed = -1 if asks is None or asks.all() else int(np.flatnonzero(~asks)[0])
    done = np.zeros(k, bool)
    todo = first
    while True:
        pivot(todo)
        done[todo] = True
        # of any two sets in different components one is outside the main one, so it is a pivot by the end
        main = label[fixed] if fixed >= 0 else np.bincount(label).argmax()
        left = np.flatnonzero(~done & (label != main))
        if not len(left):
            return label
        todo = int(left[0])


def _groups(batches, keys):
    """Arrow batches sorted by keys, as (key, columns as dict of lists) for each group."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[c].to_numpy() for c in keys]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held).to_pydict()
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).to_pydict()


def _matcher(percent: int):
    def match(batches):
        """Rows lead, chunk, node, tokens, asks. Gives node, root: the links of each group as stars."""
        for (lead, _), group in _groups(batches, ["lead", "chunk"]):
            asks = {}
            for v, s, a in zip(group["node"], group["tokens"], group["asks"]):
                asks[v] = (s, a and asks.get(v, (s, True))[1])
            if len(asks) < 2:
                continue
            node = np.array(list(asks), np.int64)
            sets = [np.frombuffer(s, np.uint64) for s, _ in asks.values()]
            flags = np.array([a for _, a in asks.values()])
            first = int(np.flatnonzero(node == lead)[0]) if lead in asks else 0
            label = local_components(node, sets, first, percent, None if flags.all() else flags)
            moved = label != np.arange(len(node))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["u", "v"])

    return match


def _prefilter(percent: int):
    def may_link(batches):
        """Drops pairs whose sketches differ in more bits than linked sets can differ in tokens."""
        for batch in batches:
            most = ((batch["nu"].to_numpy() + batch["nv"].to_numpy()) * (100 - percent)).tolist()
            keep = [(100 + percent) * differing_bits(a, b) <= m for a, b, m in zip(batch["ka"].to_pylist(), batch["kb"].to_pylist(), most)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["u"].filter(mask), batch["v"].filter(mask)], names=["u", "v"])

    return may_link


def have_company(sketch: list[bytes], n: np.ndarray, percent: int) -> np.ndarray:
    """For each sketch whether that of another set allows a link with it."""
    size = min(map(len, sketch))
    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0) for x in sketch]).view(np.uint64)
    found = np.zeros(len(n), bool)
    for i in range(len(n)):
        if not found[i]:
            near = (100 + percent) * np.bitwise_count(bits ^ bits[i]).sum(1, dtype=np.int64) <= (100 - percent) * (n + n[i])
            near[i] = False
            found |= near
            found[i] = near.any()
    return found


def _accompanied(percent: int, most: int):
    def accompanied(batches):
        """Rows lead, chunk, node, asks, n, sketch by group: drops those that can link to none of their group; groups of over most rows go on whole."""
        for (lead, chunk), group in _groups(batches, ["lead", "chunk"]):
            k = len(group["node"])
            keep = have_company(group["sketch"], np.array(group["n"], np.int64), percent) if k <= most else np.ones(k, bool)
            if keep.any():
                columns = [pa.array(np.full(k, lead)), pa.array(np.full(k, chunk)), pa.array(group["node"], pa.int64()), pa.array(group["asks"], pa.bool_())]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in columns], names=["lead", "chunk", "node", "asks"])

    return accompanied


def _verifier(percent: int):
    def verify(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch["sa"], batch["sb"]):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["u"].filter(mask), batch["v"].filter(mask)], names=["u", "v"])

    return verify


def _sized(df: DataFrame, small: int) -> DataFrame:
    """A written table, marked for broadcast if it has at most small rows."""
    return F.broadcast(df) if df.limit(small + 1).count() <= small else df


def _same(df: DataFrame, key: list[str], dealt: list[str], **ends: Column) -> DataFrame:
    """df (token, run, ...) with aggregates over the rows of a token and run.

    The rows of a dealt token (run below 0) are spread over tasks and stay so: there are at most HINTS dealt tokens, whose
    aggregates are broadcast. The others have few rows and meet in a window.
    """
    w = Window.partitionBy(*key)
    few = df.where("run >= 0").withColumns({name: end.over(w) for name, end in ends.items()})
    hot = df.where("run < 0")
    told = hot.groupBy(*dealt).agg(*(end.alias(name) for name, end in ends.items()))
    return few.unionByName(hot.join(F.broadcast(told), dealt))


def _classes(docs: DataFrame, percent: int = PERCENT, *, hints: int = HINTS, cost: int = COST, max_matches: int = MAX_MATCHES, split: int = SPLIT, chunk: int = CHUNK, small: int = SMALL) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, h (hash of the text), n, top (a node that stands for its component, null without an id or shingles) and component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    seen = staged(hashed.mapInArrow(_summarise, "is_token boolean, id long, h long, node long, n long, sketch binary"))
    rows = seen.where("not is_token").select(F.col("id").alias("doc_id"), "h", "node", "n")
    top = seen.where("is_token").groupBy("id").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "id").limit(hints).toPandas().sort_values("id")
    held = spark.sparkContext.broadcast((top["id"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    met = docs.mapInArrow(_emitter(held, percent, cost, max_matches, split), "token long, node long, info long")
    met = met.repartition("token", F.expr("info & 255")).sortWithinPartitions("token", F.expr("info >> 24"), "node")
    shared = staged(met.mapInArrow(_bucketer(percent), "token long, node long, info long, run long"))
    sketch = staged(seen.where("sketch is not null").select("node", "n", "sketch").dropDuplicates(["node"]))
    one = rows.where("doc_id is not null and n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def sets(places: DataFrame) -> DataFrame:
        """places: node, lead, chunk, asks. The set of each node at each of its places."""
        wanted = places.groupBy("node").agg(F.collect_list(F.struct("lead", "chunk", "asks")).alias("places"))
        wanted = staged(wanted.join(one, "node"))
        return docs.join(_sized(wanted, small), "doc_id").select("text", "node", "places").mapInArrow(_fetch, "lead long, chunk long, node long, asks boolean, tokens binary")

    def matched(places: DataFrame) -> DataFrame:
        told = places.join(sketch, "node").repartition("lead", "chunk").sortWithinPartitions("lead", "chunk", "node")
        places = staged(told.select("lead", "chunk", "node", "asks", "n", "sketch").mapInArrow(_accompanied(percent, GROUP), "lead long, chunk long, node long, asks boolean"))
        met = sets(places).repartition("lead", "chunk").sortWithinPartitions("lead", "chunk", "node")
        return staged(met.mapInArrow(_matcher(percent), "u long, v long"))

    # within leads; a lead is in its own group, in each chunk of it, whatever its own lead
    led = _same(shared, ["token", "run"], ["token"], lead=F.min("node"))
    own = staged(led.groupBy("node").agg(F.min("lead").alias("lead"), F.max(F.expr("info >> 24")).alias("n")))
    led = own.where("lead <> node").select(F.col("lead").alias("node")).distinct().join(own.select("node", "n"), "node").select("node", F.col("node").alias("lead"), "n")
    members = own.where("lead <> node").unionByName(led)
    large = staged(members.groupBy("lead").agg(F.ceil(F.sum("n") / chunk).alias("chunks")).where("chunks > 1"))
    members = members.join(_sized(large, small), "lead", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    members = staged(members.withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)")).drop("n"))
    every = F.explode(F.expr("sequence(0L, chunks - 1)"))
    spread = members.where("node <> lead").unionByName(members.where("node = lead").withColumn("chunk", every))
    links = matched(spread.select("node", "lead", "chunk", F.lit(True).alias("asks")))
    many = members.where("chunks > 1")
    if many.take(1):
        # nodes outside the main component of their lead visit every chunk of it
        roots = connected(links)
        placed = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        main = placed.groupBy("lead", "root").count().groupBy("lead").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
        placed = placed.join(_sized(staged(main), small), "lead").withColumn("asks", F.col("root") != F.col("main"))
        again = placed.where("not asks").unionByName(placed.where("asks").withColumn("chunk", every))
        links = links.unionByName(matched(again.select("node", "lead", "chunk", "asks")))
    roots = staged(connected(links) if _overlaps(links) else links.select(F.col("u").alias("node"), F.col("v").alias("root")))

    # between leads
    known = shared.join(own.select("node", "lead"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = _same(known, ["token", "run"], ["token"], a=F.min("lead"), b=F.max("lead"), c=F.min("root"), d=F.max("root")).where("a <> b and c <> d")
    known = staged(known.select("token", "run", "node", "lead", "root", F.expr("info >> 24").alias("n"), F.expr("info >> 16 & 255").alias("level"), F.expr("info >> 8 & 255").alias("need")))
    x, y = known.alias("x"), known.alias("y")
    pairs = x.join(y, F.expr(f"""x.token = y.token and x.run = y.run and x.node < y.node and x.lead <> y.lead and x.root <> y.root and x.node <> y.lead and y.node <> x.lead
        and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and greatest(x.level, y.level) <= least(x.need, y.need)"""))  # fmt: skip
    pairs = pairs.groupBy(F.col("x.node").alias("u"), F.col("y.node").alias("v")).agg(
        F.count("*").alias("k"), F.min(F.expr("least(x.need, y.need)")).alias("need"), F.min("x.n").alias("nu"), F.min("y.n").alias("nv")).where("k >= need")
    pairs = staged(pairs.select("u", "v", "nu", "nv"))
    bits = sketch.select("node", "sketch")
    both = pairs.join(bits.toDF("u", "ka"), "u").join(bits.toDF("v", "kb"), "v")
    pairs = staged(both.select("u", "v", "nu", "nv", "ka", "kb").mapInArrow(_prefilter(percent), "u long, v long"))
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    full = sets(wanted.select("node", F.lit(0).cast("long").alias("lead"), F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("asks"))).select("node", "tokens")
    with_u = pairs.join(full.toDF("u", "sa"), "u")
    between = with_u.join(full.toDF("v", "sb"), "v").select("u", "v", "sa", "sb").mapInArrow(_verifier(percent), "u long, v long")
    joined = between.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
    top_roots = connected(joined.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))

    # copies: each class of equal sets gets the smallest doc_id of its component
    merged = one.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    merged = merged.join(top_roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("top", F.coalesce("top", "root"))
    best = merged.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    classes = merged.join(best, "top").select("node", "top", "component_id")
    linked = rows.join(classes, "node", "left").withColumn("joins", F.expr("doc_id is not null and n > 0"))
    alone = F.col("doc_id")
    return linked.select("doc_id", "h", "n", F.expr("case when joins then top end").alias("top"), F.when(F.col("joins"), F.col("component_id")).otherwise(alone).alias("component_id"))


def components(docs: DataFrame, percent: int = PERCENT, **options: int) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text). options: see `_classes`."""
    return _classes(docs, percent, **options).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _overlaps(links: DataFrame) -> bool:
    """Whether stars of different groups share a node, so that they must be joined."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("w")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("w")).distinct())
    return bool(ends.groupBy("x").agg(F.count("*").alias("k")).where("k > 1").take(1))


def _free(name: str, columns: list[str]) -> str:
    """name, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def keep_one(docs: DataFrame, percent: int = PERCENT, small: int = SMALL, **options: int) -> DataFrame:
    """One row of docs for each component: its smallest doc_id, of several texts under that id the one of the smallest hash. The columns stay.

    Rows alike in doc_id and text are one: the first by their JSON stays. Rows of one doc_id whose texts are in different
    components are judged apart. Rows without an id or a word link with nothing, and all of them stay.
    """
    rows = staged(_classes(docs.select("doc_id", "text"), percent, small=small, **options).where("top is not null").select("doc_id", "h", "top", "component_id"))
    heads = rows.where("doc_id = component_id")
    told = staged(heads.groupBy("top").agg(F.min("h").alias("first"), F.count("*").alias("rows")).where("rows > 1"))
    gone = rows.where("doc_id <> component_id").select("doc_id", "h")
    doc_id, h, whole = (_free(name, docs.columns) for name in ("doc", "hash", "row"))
    key = [F.col("doc_id").cast("long") == F.col(doc_id), F.xxhash64(F.col("text").cast("string")) == F.col(h)]
    again = None
    if told.take(1):  # several rows under the smallest id of a component: other texts go, repeated rows become one
        several = heads.join(told, "top")
        gone = gone.unionByName(several.where("h <> first").select("doc_id", "h"))
        again = staged(several.where("h = first").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h").toDF(doc_id, h))
    gone = staged(gone.distinct().toDF(doc_id, h))
    kept = docs.join(_sized(gone, small), key, "left_anti")
    if again is None or not again.take(1):
        return kept
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = kept.join(_sized(again, small), key, "left_semi").select(F.col("doc_id").alias(doc_id), F.xxhash64(F.col("text").cast("string")).alias(h), row.alias(whole))
    once = repeated.groupBy(doc_id, h).agg(F.min_by(whole, F.to_json(whole)).alias(whole))
    once = once.select(*(F.col(whole).getField(c).alias(c) for c in docs.columns))
    return kept.join(_sized(again, small), key, "left_anti").unionByName(once)


def op9(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""
