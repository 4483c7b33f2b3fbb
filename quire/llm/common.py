"""Small helpers of the operators."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text, under fixed names, whatever else the table has."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def rename(df: DataFrame, **names: str) -> DataFrame:
    return functools.reduce(lambda d, kv: d.withColumnRenamed(*kv), names.items(), df)


def checkpoints(spark: SparkSession) -> None:
    """The shared folder is the one that spark.checkpoint.dir names. Without it a local session, as in tests, gets a temporary folder; a cluster has none that all its machines see, so that is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="quire-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)


def join_often(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined by `key` to a table with a row for each value and `n`, how many rows have it. Rows of a value that over a thousandth of all have are salted with the number of the task that reads them, so that
    no hot value meets in one task; the list of such values, a thousand at most, is broadcast, and their rows of the table are repeated, two thousand times at most in all."""
    step = max(1, total // 1000)
    often = table.where(F.col("n") > step).select(key, (F.floor(F.col("n") / step) + 1).cast("int").alias("own_salts"))
    marked = rows.join(F.broadcast(often), key, "left").withColumn("own_salt", F.coalesce(F.pmod(F.spark_partition_id(), F.col("own_salts")), F.lit(0))).drop("own_salts")
    salts = F.when(F.col("n") > step, F.floor(F.col("n") / step)).otherwise(0).cast("int")
    return marked.join(table.withColumn("own_salt", F.explode(F.sequence(F.lit(0), salts))).drop("n"), [key, "own_salt"]).drop("own_salt")


def clean(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
