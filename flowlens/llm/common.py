"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch on its way to Python in what `staged` runs: rows of long texts then come a few at a time.
BATCH_BYTES = "8m"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the session's spark.checkpoint.dir. A local one only in local mode where that is unset, as in tests; a cluster without one is refused."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = os.path.join(tempfile.gettempdir(), "flowlens-checkpoint")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, size: str = BATCH_BYTES):
    """What is run inside sends the executors' Python at most about size at once; afterwards the session's setting holds again."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, size)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def staged(df: DataFrame, *keys: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, and survives the loss of executors."""
    path = shared_dir(df.sparkSession)
    writer = df.write.mode("errorifexists")
    with small_batches(df.sparkSession):
        (writer.partitionBy(*keys) if keys else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame) -> DataFrame:
    """text and fw_docs, a struct of all columns, whose names then can't clash with those that an operator adds."""
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("fw_docs"))


def given_back(out: DataFrame, docs: DataFrame, text: Column, changed: Column | None = None) -> DataFrame:
    """The columns of docs out of fw_docs, with text replaced and n_chars, where docs has it, its length (where changed holds)."""
    columns = []
    for field in docs.schema:
        value = F.col("fw_docs").getField(field.name)
        if field.name == "text":
            value = text.cast(field.dataType)
        elif field.name == "n_chars":
            length = F.length(text).cast(field.dataType)
            value = length if changed is None else F.when(changed, length).otherwise(value)
        columns.append(value.alias(field.name))
    return out.select(*columns)
