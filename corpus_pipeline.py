"""A corpus pipeline of five stages; each calls one operator of ``backmatch.llm``.

Each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from backmatch.llm.byte_bpe import encode_documents
from backmatch.llm.common import checkpoint_folder, delete_folder, table
from backmatch.llm.decontamination import drop_contaminated
from backmatch.llm.quality import keep_good
from backmatch.llm.secrets import redact
from backmatch.llm.simhash import keep_representatives


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with digests of the ids and of the bytes they decode to."""
    return encode_documents(docs, ids=True, keep=("lang", "source", "n_chars"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: The classifier, the component search and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What passes between them is written in the shared folder and deleted
    once the next stage is written; the rows that the last stage reads stay, as it's only run by the caller."""
    docs = table(spark, sf_dir, "documents")
    at = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{at}/{k}-{name}")
        if before:
            delete_folder(spark, before)
        before = f"{at}/{k}-{name}"
        docs = spark.read.parquet(before)
    return docs
