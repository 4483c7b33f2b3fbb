"""Corpus pipeline: quality classifier, SimHash near-dedup, substring dedup, packing.

Each stage works on all rows of the one before; all but the last return the columns of documents. Rows with nulls, ties and repeated rows pass
as the operators' docstrings say; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import checkpoints, table
from quire.llm.near import one_of_each
from quire.llm.packing import pack
from quire.llm.phrases import dedup_phrases
from quire.llm.quality import fit_labels, judge

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = fit_labels(docs, table(spark, sf_dir, "labels"))
    return judge(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard similarity of 0.8 or more) one row stays, that of least doc_id; rows without an id stay only where no linked row has one."""
    return one_of_each(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has are cut; a text without such stays as it is."""
    out = dedup_phrases(docs.select(*COLUMNS), carry=("text", "lang", "source", "n_chars"))
    return out.select(
        "doc_id", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept")).alias("text"), "lang", "source",
        F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("kept").cast("long")).alias("n_chars"),
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]
#: SQL can express neither the fitted classifier nor XXH64; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
