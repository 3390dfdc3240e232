"""Token sequences in training order, as fixed-stride binary shards.

Texts are encoded by a byte-level BPE, each distinct word of a slice of texts once (see _words), an end id after each text, and
the ids of a partition's texts are laid end to end and cut in sequences of `length` ids (the last one of the partition is filled up with end ids). A first job counts each partition's
sequences; the second numbers them 0..N-1 in the order of the partitions. A keyed Feistel permutation over the next power of
four, walked along its cycle until it falls below N, gives each number its slot. Rows are range-partitioned by slot, so each
task holds whole shards of `per_shard` slots and streams them out.

Slot s is the record of 2 * length bytes (uint16, little-endian) at byte (s % per_shard) * 2 * length of shard
s // per_shard: a reader goes through slots in order, or begins again anywhere. A shard is written under a name of its own
and then renamed, so a lost or repeated task leaves no half shard; a task whose slots don't follow each other fails.

Only counts come to the driver: one number for each partition.

Defined results: null text gives no ids, empty text the end id alone; a null doc_id is kept in the lists of ids; repeated
rows are encoded again; an empty table gives no shards; other columns are ignored. The same input, key and partitioning give
the same shards.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import shared_dir, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary of RANKS cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
LENGTH = 2048
PER_SHARD = 8192
KEY = 20240601
#: A space beside another blank, or at the end: there the pattern doesn't begin anew.
BESIDE = r"[\t-\r\x{85}\pZ] | [\t-\r\x{85}\pZ]| \z"
#: Bytes from which a text counts as long, and of texts whose words are encoded at once.
LONG = 1 << 20
SLICE_BYTES = 8 << 20
ROUNDS = 6


def _round(half: np.ndarray, key: int, i: int, mask: int) -> np.ndarray:
    h = half + np.uint64((key * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) & np.uint64(mask)


def slots_of(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each index below n: a permutation of 0..n-1 that key chooses."""
    bits = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = (1 << bits) - 1
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(bits), out[todo] & np.uint64(mask)
        for i in range(rounds):
            left, right = right, left ^ _round(right, key, i, mask)
        out[todo] = left << np.uint64(bits) | right
        todo = out >= n
    return out.astype(np.int64)


def index_of(slots: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The inverse of slots_of."""
    bits = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = (1 << bits) - 1
    out = slots.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(bits), out[todo] & np.uint64(mask)
        for i in reversed(range(rounds)):
            left, right = right ^ _round(left, key, i, mask), left
        out[todo] = left << np.uint64(bits) | right
        todo = out >= n
    return out.astype(np.int64)


def _read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_encoders: dict[str, tuple] = {}


def _encoder(ranks, name: str) -> tuple:
    """The encoder, and the bytes of each id."""
    import tiktoken

    if name not in _encoders:
        _encoders.clear()
        sizes = np.zeros(1 << 16, np.int64)
        for token, rank in ranks.value.items():
            sizes[rank] = len(token)
        _encoders[name] = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={}), sizes
    return _encoders[name]


def _slices(batches) -> Iterator[pa.RecordBatch]:
    """The rows whose text is not null, about SLICE_BYTES at a time."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch["text"]))
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


def _words(texts: pa.Array, encoder, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct words one after the other, the number of each word's, and the words of all texts with the offsets of each text.

    PATTERN lets nothing but blanks stand before a space, so a text falls apart at single spaces: each word but the first
    takes the space before it. Distinct words are encoded as one text, which falls apart in the same way. Texts where a space
    is beside another blank, and long ones, are a single word.
    """
    whole = pc.or_(pc.match_substring_regex(texts, BESIDE), pc.greater_equal(pc.binary_length(texts), LONG))
    lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")  # of an empty text one empty word
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words, first = lists.flatten(), offsets[:-1]
    later = np.ones(len(words), bool)
    later[first] = False
    coded = words.filter(pa.array(later)).dictionary_encode()
    distinct = coded.dictionary
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")[0].as_py()
    ids = np.array(encoder.encode_ordinary(" " + joined) if len(distinct) else [], np.uint16)
    ends, upto = np.cumsum(sizes[ids]), np.cumsum(pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    last = np.searchsorted(ends, upto)
    if not np.array_equal(ends[last], upto):
        raise RuntimeError("an id reaches over the start of a word")
    alone = [_encoded(encoder, x) for x in pc.if_else(whole, texts, words.take(pa.array(first))).to_pylist()]
    index = np.empty(len(words), np.int64)
    index[later] = coded.indices.to_numpy(zero_copy_only=False)
    index[first] = len(distinct) + np.arange(len(first))
    return np.concatenate([ids, *alone]), np.concatenate([np.diff(last, prepend=-1), [len(x) for x in alone]]).astype(np.int64), index, offsets


def _encoded(encoder, text: str) -> np.ndarray:
    """Through a list, which is faster, or for long texts an array, which is smaller."""
    return np.array(encoder.encode_ordinary(text) if len(text) < LONG else encoder.encode_to_numpy(text, disallowed_special=()), np.uint16)


def _ids(batches, ranks, name: str) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, its ids) for each text that is not null."""
    encoder, sizes = _encoder(ranks, name)
    for rows in _slices(batches):
        ids, lengths, index, offsets = _words(rows["text"], encoder, sizes)
        n, starts = lengths[index], (np.cumsum(lengths) - lengths)[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])]
        for doc_id, start, end in zip(rows["doc_id"].to_pylist(), ends[offsets[:-1]], ends[offsets[1:]]):
            yield doc_id, flat[start:end]


def _n_ids(batches, ranks, name: str) -> int:
    """Number of ids of all texts, with an end id after each."""
    encoder, sizes = _encoder(ranks, name)
    total = 0
    for rows in _slices(batches):
        _, lengths, index, _ = _words(rows["text"], encoder, sizes)
        total += int(lengths[index].sum()) + rows.num_rows
    return total


def _cut(rows: Iterator[tuple[object, np.ndarray]], length: int, end: int) -> Iterator[tuple[np.ndarray, int, list]]:
    """Sequences of length ids, the number of ids that are no filling, and the doc_ids of the texts in each."""
    held, size, docs = [], 0, []
    for doc_id, found in rows:
        ids = np.append(found, np.uint16(end))
        while len(ids):  # each text has ids, and adds its doc_id to each sequence that it reaches
            docs.append(doc_id)
            part, ids = ids[: length - size], ids[length - size :]
            held.append(part)
            size += len(part)
            if size == length:
                yield np.concatenate(held), size, docs
                held, size, docs = [], 0, []
    if size:
        yield np.concatenate([*held, np.full(length - size, end, np.uint16)]), size, docs


def write_shards(docs: DataFrame, out_dir: str | None = None, ranks_path: str = RANKS, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, end: int = END) -> DataFrame:
    """Writes the shards of docs (doc_id, text) under out_dir, or a new folder in the shared one, when the result is used.

    Returns a row for each sequence: slot, shard (its file), at (byte in it), n_ids, doc_ids.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _read_ranks(ranks_path)
    if max([end, *found.values()]) > 0xFFFF:
        raise ValueError("ids above 65535 don't fit into records of 16 bits")
    ranks = spark.sparkContext.broadcast(found)
    name = uuid.uuid4().hex
    out_dir = out_dir or shared_dir(spark)

    def count(batches):
        total = _n_ids(batches, ranks, name)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([-(-total // length)])], names=["p", "n"])

    counts = {r["p"]: r["n"] for r in docs.mapInArrow(count, "p long, n long").collect()}  # a row for each partition
    n = sum(counts.values())
    before, total = {}, 0
    for p in sorted(counts):
        before[p] = total
        total += counts[p]

    def cut(batches):
        index = before.get(TaskContext.get().partitionId(), 0)
        out: list[tuple] = []

        def sent():
            slots = slots_of(np.arange(index - len(out), index), n, key)
            return pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))],
                names=["slot", "record", "n_ids", "doc_ids"],
            )

        for ids, size, of in _cut(_ids(batches, ranks, name), length, end):
            out.append((ids.astype("<u2").tobytes(), size, of))
            index += 1
            if len(out) == 512:
                yield sent()
                out = []
        if out:
            yield sent()

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(out_dir)
        store.create_dir(base, recursive=True)
        shard, stream, name, at = None, None, "", 0

        def close():
            stream.close()
            store.move(name, f"{base}/shard-{shard:08d}.bin")

        for batch in batches:
            slots = batch["slot"].to_numpy()
            for slot, record in zip(slots, batch["record"]):
                if slot // per_shard != shard:
                    if stream is not None:
                        if at != (shard + 1) * per_shard:
                            raise RuntimeError(f"slot {at} is missing: the input changed between the two jobs")
                        close()
                    shard, at = int(slot // per_shard), int(slot // per_shard) * per_shard
                    name = f"{base}/.{shard:08d}-{uuid.uuid4().hex}"
                    stream = store.open_output_stream(name)
                if slot != at:
                    raise RuntimeError(f"slot {at} is missing: the input changed between the two jobs")
                stream.write(record.as_buffer())
                at += 1
            names = pa.array([f"shard-{s // per_shard:08d}.bin" for s in slots])
            yield pa.RecordBatch.from_arrays(
                [batch["slot"], names, pa.array(slots % per_shard * 2 * length), batch["n_ids"], batch["doc_ids"]], names=["slot", "shard", "at", "n_ids", "doc_ids"])
        if stream is not None:
            if at != min((shard + 1) * per_shard, n):
                raise RuntimeError(f"slot {at} is missing: the input changed between the two jobs")
            close()

    ready = docs.mapInArrow(cut, "slot long, record binary, n_ids long, doc_ids array<long>")
    ready = ready.repartitionById(max(1, -(-n // per_shard)), F.expr(f"cast(slot div {per_shard} as int)"))  # range i of slots to task i
    return ready.sortWithinPartitions("slot").mapInArrow(write, "slot long, shard string, at long, n_ids long, doc_ids array<long>")


def read_slots(out_dir: str, start: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The sequences of count slots from start on, in order."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(out_dir)
    slot = start
    while slot < start + count:
        shard = slot // per_shard
        upto = min(start + count, (shard + 1) * per_shard)
        with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek((slot - shard * per_shard) * 2 * length)
            for _ in range(slot, upto):
                yield np.frombuffer(f.read(2 * length), "<u2")
        slot = upto


def op8(spark, sf_dir: str) -> DataFrame:
    return write_shards(table(spark, sf_dir, "documents"))
