"""From raw documents to token ids, in five stages; each works on all that the one before kept.

1. quality rules: failing lines go from the texts, rejected documents go.
2. n-gram Jaccard join: the document with the smallest doc_id of each group of near copies stays.
3. benchmark decontamination: documents that hold a benchmark window go.
4. secret scans: secrets in the texts are replaced by a label; no document goes.
5. SentencePiece: the ids of each text, pieces taken by the best sum of scores.

Stages 1 to 4 return the columns of documents; n_chars follows the text. Defined results are those of the operators: null
texts fail the quality rules, null ids stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, ngram_join, quality_rules, secrets, tokens
from flowlens.llm.common import staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(secrets.default_samples(spark)))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encode_checked(docs.select("doc_id", F.col("text").cast("string")), kind=tokens.KIND).select("doc_id", "n_tokens", "round_trip", "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("sentencepiece", tokens_stage),
]
#: Markov models and piece lattices are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs)
    return docs
