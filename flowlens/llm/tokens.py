"""SentencePiece encoding and decoding, and token counts, on columns.

The work is row by row, in Arrow batches, without a shuffle; the model (under MAX_PIECES pieces) is broadcast.
Encoding walks the trie of a batch's sorted distinct words; counting runs an Aho-Corasick automaton over them and
carries only scores and counts (see pieces). Whole texts are used, of any length.

Defined results: null text has null ids, 0 tokens and a null decoded text; empty text has no ids. Repeated rows, null ids
and other columns stay as they are; columns of the input called like an added one are replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import pieces
from flowlens.llm.common import table

#: Where the public vocabularies are; every function takes another path.
MODEL = os.environ.get("FLOWLENS_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: How the queries and the pipeline read the pieces of MODEL: as a unigram vocabulary with the scores of the file, whatever its
#: own kind. None, the default of the functions, reads them as the file says.
KIND = "unigram"
#: Bytes of a batch that are worked on and sent back at once.
PART_BYTES = 2 << 20
_IDS = pa.list_(pa.int32())


def _each(df: DataFrame, model_path: str, kind: str | None, work, added: list[tuple[str, T.DataType]]) -> DataFrame:
    """Adds to df the columns that work(model, batch) gives."""
    held = df.sparkSession.sparkContext.broadcast(pieces.load(model_path, kind))
    kept = df.drop(*(n for n, _ in added))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in added)])
    names = [f.name for f in schema.fields]
    drop = [i for i, c in enumerate(df.columns) if c.lower() in {n.lower() for n, _ in added}]

    def run(batches):
        model = held.value
        for batch in batches:
            rows = max(1, batch.num_rows * PART_BYTES // max(batch.nbytes, 1))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                columns = [c for i, c in enumerate(part.columns) if i not in drop]
                yield pa.RecordBatch.from_arrays([*columns, *work(model, part)], names=names)

    return df.mapInArrow(run, schema)


def _masked(ids: pa.ListArray, texts: pa.Array) -> pa.Array:
    if not texts.null_count:
        return ids
    return pc.if_else(pc.is_valid(texts), ids, pa.scalar(None, _IDS))


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", model_path: str = MODEL, kind: str | None = None) -> DataFrame:
    """df with ids_col: the piece ids of text_col."""
    return _each(df, model_path, kind, lambda m, b: [_masked(m.encode(b[text_col]), b[text_col])], [(ids_col, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model_path: str = MODEL, kind: str | None = None) -> DataFrame:
    """df with text_col: the text of ids_col."""

    def work(model, batch):
        ids = batch[ids_col]
        text = model.decode(pa.array(ids.to_pylist(), _IDS) if ids.null_count else ids)
        return [pc.if_else(pc.is_valid(ids), text, pa.scalar(None, pa.string()))]

    return _each(df, model_path, kind, work, [(text_col, T.StringType())])


def count(df: DataFrame, text_col: str = "text", n_col: str = "n_tokens", model_path: str = MODEL, kind: str | None = None) -> DataFrame:
    """df with n_col: the number of ids of text_col."""
    return _each(df, model_path, kind, lambda m, b: [pa.array(m.count(b[text_col]))], [(n_col, T.LongType())])


def encode_checked(df: DataFrame, text_col: str = "text", model_path: str = MODEL, kind: str | None = None) -> DataFrame:
    """df with ids, n_tokens and round_trip (whether decoding gives the text back; null for null text)."""

    def work(model, batch):
        texts = batch[text_col]
        ids = model.encode(texts)
        n = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        return [_masked(ids, texts), pa.array(n), pc.equal(model.decode(ids), texts)]

    return _each(df, model_path, kind, work, [("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("round_trip", T.BooleanType())])


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string"))
    return encode_checked(docs, kind=KIND).select("doc_id", "n_tokens", "round_trip", "ids")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string"))
    return count(docs, kind=KIND).select("doc_id", "n_tokens")
