"""Ingestion of arriving files: an extension of the batch views, with the same kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pdf import view

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, glob: str = "*.pdf", late: str = "1 day") -> DataFrame:
    """A stream of files of a folder; one that comes again with equal path and length within the watermark is dropped."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).load(path)
    return files.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["path", "length"])


def ingest(spark: SparkSession, path: str, name: str, to: str, checkpoint: str, **options):
    """Appends a view of arriving files to a Parquet table, until all there now are read; a restart goes on from the checkpoint."""
    out = view(arriving(spark, path), name, "path", **options)
    return out.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pages_by_hour(spark: SparkSession, path: str) -> DataFrame:
    """Pages that arrive in each hour: a windowed count over the watermark."""
    docs = view(arriving(spark, path), "documents", "path", "modificationTime")
    return docs.groupBy(F.window("modificationTime", "1 hour").alias("hour")).agg(F.sum("pages").alias("pages"))
