"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. The documents that a query reads are written before its time is taken."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.plans import queries as Q
from quire.sources.pdf import view

HEADLINE = ("doc_text_roundtrip", "doc_page_count", "doc_markdown_roundtrip", "size_histogram", "element_kind_counts", "two_column_order", "xref_merge_latest", "value_tree_paths", "gutter_gaps", "interval_packing", "ruling_crossings", "render_colors")
#: Documents that are rendered whole.
RENDERED = 200


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.files.openCostInBytes", "256k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out, held, write = {}, [], Q.written

    def written(df, build, *keys):
        """Files that are there already."""
        held.append(write(df, build, *keys).repartition(4 * cpus).persist())
        held[-1].count()
        return held[-1]

    def timed(name, df):
        t = time.time()
        df.write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - t, 3)

    Q.doc_page_count(spark, "/root/testdata/sf0.001").count()  # starts the workers
    Q.written = written
    for name in HEADLINE:
        timed(name, Q.QUERIES[name](spark, sf))
        while held:
            held.pop().unpersist()
    files = Q._documents(spark, sf)
    pages = view(files, "documents").agg(F.sum("pages")).first()[0]
    for name in ("documents", "text", "markdown"):
        timed(f"view_{name}", view(files, name))
    rate = {f"{n}_pages_per_s": round(pages / out[f"view_{n}"], 1) for n in ("documents", "text", "markdown")}
    some = files.limit(RENDERED).repartition(4 * cpus).persist()
    drawn = view(some, "documents").agg(F.sum("pages")).first()[0]
    timed("view_png", view(some, "png"))
    rate["png_pages_per_s"] = round(drawn / out["view_png"], 1)
    print(json.dumps({"metric": "headline queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf, "pages": pages, **rate}))


if __name__ == "__main__":
    main()
