"""The registered queries of the document engine, with SQL that computes the same from the tables that the documents were written from."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, BinaryType

from .. import corpus as C
from ..functions import geometry as G
from ..functions import text as T
from ..kernels.objects import Name, Ref
from ..operators import tables as O
from ..sources.pdf import view
from .jq import query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt evenly over tasks. A document takes far longer to make and read than its row is long, so the number of tasks must not follow from bytes: a table in one row group would be one task.

    By its key, what is grouped next: rows then move once, and what is grouped keeps the number.
    """
    s = df.sparkSession
    tasks = max(int(s.conf.get("spark.sql.shuffle.partitions")), 4 * s.sparkContext.defaultParallelism)
    return df.repartition(tasks, *(by or df.columns))


def written(df: DataFrame, build: Callable[..., bytes], *keys: str) -> DataFrame:
    """The key columns and a document made of each row's columns."""
    keys = keys or ("doc_id",)
    schema = StructType([*(df.schema[k] for k in keys), StructField("content", BinaryType())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                docs = [build(*row.values()) for row in b.to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), pa.array(docs, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def _flavoured(doc_id, text):
    return C.from_text(text, C.FLAVOURS[doc_id % len(C.FLAVOURS)])


def _documents(spark, sf, build=_flavoured):
    return written(dealt(table(spark, sf, "documents").select("doc_id", "text")), build)


_LINES = "[x FOR x IN string_split(coalesce(text, ''), chr(10)) IF x <> '']"


@registered(f"SELECT doc_id, array_to_string({_LINES}, chr(10)) AS text FROM documents")
def doc_text_roundtrip(spark, sf):
    out = view(_documents(spark, sf), "document_text")
    return out.select("doc_id", F.replace("text", F.lit("\f"), F.lit("\n")).alias("text"))


@registered(f"SELECT doc_id, CAST(greatest(1, ceil(len({_LINES}) / 36.0)) AS BIGINT) AS pages FROM documents")
def doc_page_count(spark, sf):
    return view(_documents(spark, sf), "documents").select("doc_id", "pages")


@registered("SELECT doc_id, '1.7' AS version, FALSE AS encrypted, '1.7' AS native_version FROM documents")
def doc_info(spark, sf):
    d = _documents(spark, sf)
    info = view(d.withColumn("native_version", T.header_version(F.col("content"))), "documents", "doc_id", "native_version")
    return info.select("doc_id", "version", "encrypted", "native_version")


def _info(key, name, segment):
    enc = (lambda s: b"\xfe\xff" + s.encode("utf-16-be"), lambda s: b"\xef\xbb\xbf" + s.encode(), lambda s: s.encode("latin-1"))[key % 3]
    return C.document([b""], C.FLAVOURS[key % 8], {"Title": enc(name), "Subject": enc(segment + " é"), "CreationDate": b"D:20240101"})


@registered("SELECT c_custkey, c_name AS title, c_mktsegment || ' é' AS subject, 'D:20240101' AS created FROM customer")
def doc_metadata(spark, sf):
    d = written(dealt(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")), _info, "c_custkey")
    return view(d, "metadata").selectExpr("c_custkey", "Title title", "Subject subject", "CreationDate created")


def _headed(doc_id, text):
    return C.from_text(text, C.FLAVOURS[doc_id % 8], 18.0)


_MARKDOWN = """
WITH l AS (SELECT doc_id, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF x <> ''] AS ls FROM documents),
m AS (SELECT doc_id, ls, len(ls) AS n, length(regexp_replace(coalesce(ls[1], ''), '\\s', '', 'g')) AS c1, length(regexp_replace(array_to_string(ls[2:], ''), '\\s', '', 'g')) AS c2 FROM l),
h AS (SELECT *, n > 1 AND c2 >= c1 AND length(trim(ls[1])) <= 120 AS head FROM m),
p AS (SELECT doc_id, head, ls, n, range(0, greatest(1, CAST(ceil(n / 36.0) AS BIGINT))) AS ps FROM h),
e AS (SELECT doc_id, n, head, [replace(x, '|', '\\|') FOR x IN ls] AS es, ls, ps FROM p)
SELECT doc_id, array_to_string([y FOR y IN [
  CASE WHEN k = 0 AND head THEN '# ' || trim(es[1]) || CASE WHEN least(n, 36) > 1 THEN chr(10) || chr(10) || array_to_string(es[2:36], chr(10)) ELSE '' END
       WHEN k = 0 AND n > 1 AND c2 >= c1 AND least(n, 36) > 1 THEN es[1] || chr(10) || chr(10) || array_to_string(es[2:36], chr(10))
       ELSE array_to_string(es[k * 36 + 1:k * 36 + 36], chr(10)) END FOR k IN ps] IF y <> ''], chr(10) || chr(10)) AS markdown
FROM (SELECT e.*, m.c1, m.c2 FROM e JOIN m USING (doc_id))
"""


@registered(_MARKDOWN)
def doc_markdown_roundtrip(spark, sf):
    return view(_documents(spark, sf, _headed), "markdown", running=True)  # a round trip has all lines


_SIZES = """
SELECT o_custkey AS doc_id, CAST(16 + 2 * (o_orderkey % 5) AS BIGINT) AS half_points, CAST(sum(length(replace(o_orderpriority, ' ', ''))) AS BIGINT) AS chars FROM orders GROUP BY ALL
"""


def _sized(doc_id, rows):
    rows = sorted((r["k"], r["t"]) for r in rows)
    pages = [C.text_page([(t, 8.0 + k % 5, "F1") for k, t in rows[i : i + 36]], leading=18) for i in range(0, len(rows), 36)]
    return C.document(pages, C.FLAVOURS[doc_id % 8])


def _sized_spans(spark, sf):
    o = dealt(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("t"))).alias("rows"))
    return view(written(o, _sized), "spans", columns=("text", "size"))


@registered(_SIZES)
def size_histogram(spark, sf):
    return O.size_histogram(_sized_spans(spark, sf), "doc_id")


@registered(f"""
WITH s AS ({_SIZES}), b AS (SELECT doc_id, arg_min(half_points, {{'a': -chars, 'b': half_points}}) AS body FROM s GROUP BY 1)
SELECT doc_id, body, half_points, CAST(least(6, dense_rank() OVER (PARTITION BY doc_id ORDER BY half_points DESC)) AS INT) AS level FROM s JOIN b USING (doc_id) WHERE half_points >= body + 2
""")
def size_ladder(spark, sf):
    return O.size_ladder(O.size_histogram(_sized_spans(spark, sf), "doc_id"), "doc_id")


def _titled(key, name, kind):
    return C.document([C.text_page([(name, 12, "F2"), *[(f"plain words of {kind} here.", 12, "F1")] * 3])], C.FLAVOURS[key % 8])


@registered("SELECT p_partkey, CASE WHEN length(trim(p_name)) <= 60 AND right(trim(p_name), 1) NOT IN ('.', ',', ';') THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN length(trim(p_name)) <= 60 AND right(trim(p_name), 1) NOT IN ('.', ',', ';') THEN 1 ELSE 0 END AS level FROM part")
def bold_titles(spark, sf):
    d = written(dealt(table(spark, sf, "part").select("p_partkey", "p_name", "p_type")), _titled, "p_partkey")
    return view(d, "blocks").where("block_no = 0").select("p_partkey", "kind", "level")


def _listed(doc_id, rows):
    lines = [f"{k + 1}. {r['p']}" if doc_id % 2 else f"- {r['p']}" for k, r in enumerate(sorted(rows, key=lambda r: r["k"]))]
    return C.document([C.text_page([(x, 12, "F1") for x in lines])], C.FLAVOURS[doc_id % 8])


@registered("""
WITH r AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, string_agg(CASE WHEN o_custkey % 2 = 1 THEN n || '. ' ELSE '- ' END || o_orderpriority, chr(10) ORDER BY n) AS markdown FROM r GROUP BY 1
""")
def list_items(spark, sf):
    o = dealt(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))).alias("rows"))
    return view(written(o, _listed, "o_custkey"), "markdown")


def _running(key, name):
    pages = [C.text_page([(f"Report of {name}", 12, "F1")], 770) + C.text_page([(f"body {k} of {name} " + "abcdefgh"[k], 12, "F1"), ("second line " + "xyzuvw"[k], 12, "F1")], 700) + C.text_page([(f"Page {k + 1} of {2 + key % 4}", 12, "F1")], 40) for k in range(2 + key % 4)]
    return C.document(pages, C.FLAVOURS[key % 8])


@registered("""
SELECT c_custkey, r.role, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 2 + c_custkey % 4 END AS BIGINT) AS n FROM customer, (VALUES ('header'), ('footer')) r(role) WHERE c_custkey % 4 <> 0
""")
def header_footer_tags(spark, sf):
    d = written(dealt(table(spark, sf, "customer").select("c_custkey", "c_name")), _running, "c_custkey")
    return view(d, "blocks").where("role is not null").groupBy("c_custkey", "role").agg(F.count(F.lit(1)).alias("n"))


@registered("""
WITH e AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS INT) AS page, o_orderpriority || ' ' || CAST(o_orderkey % 7 AS VARCHAR) AS text, CAST(700 + o_orderkey % 3 * 2 AS DOUBLE) AS y, count(*) OVER (PARTITION BY o_custkey) AS pages FROM orders),
n AS (SELECT *, lower(trim(regexp_replace(regexp_replace(text, '\\d+', '#', 'g'), '\\s+', ' ', 'g'))) AS norm FROM e)
SELECT doc_id, page, pages >= 3 AND count(*) OVER (PARTITION BY doc_id, norm ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= greatest(3, pages // 2) AS running FROM n
""")
def running_lines(spark, sf):
    w = Window.partitionBy("o_custkey")
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("page"), F.concat_ws(" ", "o_orderpriority", (F.col("o_orderkey") % 7).cast("string")).alias("text"), (F.lit(700) + F.col("o_orderkey") % 3 * 2).cast("double").alias("y"), F.count(F.lit(1)).over(w).alias("pages"))
    return O.running_lines(e).select("doc_id", "page", "running")


@registered("SELECT doc_id, lower(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[0-9]+', '#', 'g'), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}]+', ' ', 'g'))) AS norm FROM documents")
def normalize_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalise_line(F.coalesce("text", F.lit(""))).alias("norm"))


_SHAPES = "CASE o_orderkey % 6 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN 'Page ' || o_orderkey WHEN 2 THEN o_orderkey || ' of 99' WHEN 3 THEN '- ' || o_orderkey || ' -' WHEN 4 THEN 'Page ' || o_orderkey || ' of 7' ELSE 'item ' || o_orderkey END"


@registered(f"SELECT o_orderkey, {_SHAPES} AS line, o_orderkey % 6 <> 5 AS is_number FROM orders")
def page_number_shapes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(_SHAPES.replace("::VARCHAR", "").replace("0 THEN o_orderkey", "0 THEN cast(o_orderkey as string)")).alias("line"))
    return o.withColumn("is_number", T.is_page_number(F.col("line")))


def _lanes(key, rows):
    cells = [["No", "Part", "Supplier"], *[[str(r["n"]), f"part {r['p']}", f"supplier {r['s']}"] for r in sorted(rows, key=lambda r: (r["n"], r["p"], r["s"]))]]
    return C.document([C.table_page(cells, [72, 250, 430])], C.FLAVOURS[key % 8])


@registered("""
SELECT l_orderkey, CASE WHEN count(*) = 1 THEN 'No Part Supplier' || chr(10) || min(l_linenumber || ' part ' || l_partkey || ' supplier ' || l_suppkey)
ELSE '| No | Part | Supplier |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || l_linenumber || ' | part ' || l_partkey || ' | supplier ' || l_suppkey || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) END AS markdown
FROM lineitem GROUP BY 1
""")
def lineitem_table_roundtrip(spark, sf):
    li = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))).alias("rows"))
    return view(written(li, _lanes, "l_orderkey"), "markdown")


def _ruled(key, region, rows):
    return C.document([C.table_page([["key", region], *[[str(r["k"]), r["n"]] for r in sorted(rows, key=lambda r: r["k"])]], [72, 250], ruled=True)], C.FLAVOURS[key % 8])


@registered("""
SELECT r_regionkey, '| key | ' || r_name || ' |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name
""")
def nation_ruled_grid(spark, sf):
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    d = r.join(n, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_regionkey", "r_name").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))).alias("rows"))
    return view(written(d, _ruled, "r_regionkey"), "markdown")


def _spanning(key, name):
    wide = "W" * int(250 / 9.44)  # 250 points at the width of the letter, so it crosses the second lane and not the third
    return C.document([C.table_page([["a1", "b1", "c1"], [wide, "", "c2"], ["a3", "b3", "c3"], [str(key), "n & m", name]], [72, 250, 430])], C.FLAVOURS[key % 8])


@registered("SELECT n_nationkey, '<table>' AS opens, TRUE AS spans, TRUE AS escaped FROM nation")
def colspan_html_table(spark, sf):
    d = written(table(spark, sf, "nation").select("n_nationkey", "n_name"), _spanning, "n_nationkey")
    m = view(d, "markdown")
    return m.select("n_nationkey", F.split_part("markdown", F.lit("\n"), F.lit(1)).alias("opens"), F.contains("markdown", F.lit('colspan="2"')).alias("spans"), F.contains("markdown", F.lit("n &amp; m")).alias("escaped"))


_PAGES = f"greatest(1, CAST(ceil(len({_LINES}) / 36.0) AS BIGINT))"


@registered(f"""
WITH p AS (SELECT doc_id, {_PAGES} AS n FROM documents)
SELECT doc_id, k.kind, CAST(CASE k.kind WHEN 'object' THEN 4 + 2 * n + CASE WHEN doc_id % 8 = 6 THEN 2 ELSE 0 END WHEN 'page' THEN n WHEN 'font' THEN 2 * n ELSE 1 END AS BIGINT) AS n FROM p, (VALUES ('font'), ('header'), ('object'), ('page'), ('startxref'), ('eof'), ('xref')) k(kind) WHERE k.kind <> 'xref' OR doc_id % 8 <> 7
""")
def element_kind_counts(spark, sf):
    e = view(_documents(spark, sf), "elements", values=False)
    return e.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT doc_id, TRUE AS in_order, TRUE AS covered FROM documents")
def element_order(spark, sf):
    d = _documents(spark, sf)
    e = view(d.withColumn("size", F.octet_length("content")), "elements", "doc_id", "size", logical=False, values=False).where("span is not null")
    w = Window.partitionBy("doc_id").orderBy("seq")
    e = e.select("doc_id", "size", "span", F.coalesce(F.lag("span.start").over(w), F.lit(0)).alias("before"))
    return e.groupBy("doc_id").agg(F.min(F.col("before") <= F.col("span.start")).alias("in_order"), F.max(F.col("span.end") >= F.col("size") - 1).alias("covered"))


def _revised(key, old, new):
    base = C.document([b""], "classic", {"Title": old.encode(), "Author": b"same"})
    num = base.count(b" 0 obj")
    at = len(base)
    body = b"%d 0 obj\n%s\nendobj\n" % (num, C.dump({"Title": new.encode(), "Author": b"same"}))
    prev = int(base.rsplit(b"startxref", 1)[1].split()[0])
    tail = b"xref\n%d 1\n%010d 00000 n \ntrailer\n%s\nstartxref\n%d\n%%%%EOF\n" % (num, at, C.dump({"Size": num + 1, "Prev": prev, "Root": Ref(1, 0), "Info": Ref(num, 0)}), at + len(body))
    return base + body + tail


@registered("SELECT c_custkey, c_mktsegment AS title, CAST(2 AS BIGINT) AS sections, CAST(1 AS BIGINT) AS revised FROM customer")
def xref_merge_latest(spark, sf):
    d = written(dealt(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")), _revised, "c_custkey")
    x = view(d, "xref_entries")
    merged = O.merge_sections(x, "c_custkey", history=True)
    revised = F.sum(F.expr("size(filter(history, h -> h.section = 0 and h.a = a))")).cast("long").alias("revised")
    n = merged.groupBy("c_custkey").agg(F.size(F.array_distinct(F.flatten(F.collect_list("history.section")))).cast("long").alias("sections"), revised).where("revised > 0")
    return view(d, "metadata").selectExpr("c_custkey", "Title title").join(n, "c_custkey")


def _duplicated(key, old, new):
    w = C.Writer("broken")
    cat, tree, info = w.add(None), w.add(None), w.add({"Title": old.encode()})
    w.objects[cat.num] = ({"Type": Name("Catalog"), "Pages": tree}, None)
    w.objects[tree.num] = ({"Type": Name("Pages"), "Kids": [], "Count": 0}, None)
    w.trailer.update({"Root": cat, "Info": info})
    b = w.bytes()
    return b.replace(b"xref\n0", b"%d 0 obj\n%s\nendobj\nxref\n0" % (info.num, C.dump({"Title": new.encode()})), 1)


@registered("SELECT c_custkey, c_mktsegment AS title FROM customer")
def recovery_last_wins(spark, sf):
    d = written(dealt(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")), _duplicated, "c_custkey")
    return view(d, "metadata").selectExpr("c_custkey", "Title title")


@registered("SELECT l_orderkey AS doc_id, CAST(l_suppkey AS BIGINT) AS num, max(l_partkey) AS offset_, arg_max(l_quantity, (l_partkey * 10 + l_linenumber) * 100 + l_quantity) AS value FROM lineitem GROUP BY ALL")
def last_definition(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("num"), ((F.col("l_partkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity")).alias("offset"), F.col("l_partkey").alias("offset_"), F.col("l_quantity").alias("value"))
    return O.last_definition(x).select("doc_id", "num", "offset_", "value")


@registered("""
WITH p AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT 's' || s_suppkey AS node, CAST(2 AS INT) AS depth, CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey WHEN s_nationkey % 2 = 0 THEN 1000 + s_nationkey ELSE 2000 + n_regionkey END AS BIGINT) AS box, CAST(CASE WHEN s_nationkey % 4 = 1 THEN 90 ELSE 0 END AS INT) AS rotate FROM p
""")
def page_tree_inheritance(spark, sf):
    r = table(spark, sf, "region").selectExpr("concat('r', r_regionkey) node", "cast(null as string) parent", "cast(2000 + r_regionkey as bigint) box", "0 rotate")
    n = table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) node", "concat('r', n_regionkey) parent", "cast(if(n_nationkey % 2 = 0, 1000 + n_nationkey, null) as bigint) box", "if(n_nationkey % 4 = 1, 450, null) rotate")
    s = table(spark, sf, "supplier").selectExpr("concat('s', s_suppkey) node", "concat('n', s_nationkey) parent", "cast(if(s_suppkey % 3 = 0, s_suppkey, null) as bigint) box", "cast(null as int) rotate")
    return O.inherit(r.unionByName(n).unionByName(s), ["box", "rotate"]).where("node like 's%' and error is null").drop("error").withColumn("rotate", G.rotation(F.col("rotate")))


def _tree(region, nations):
    w = C.Writer("classic")
    cat, root = w.add(None), w.add(None)
    kids = []
    for n in sorted(nations, key=lambda x: x["k"]):
        mid = w.add(None)
        leaf = w.add({"Type": Name("Page"), "Parent": mid, **({"Rotate": 90} if n["k"] % 2 else {})})
        w.objects[mid.num] = ({"Type": Name("Pages"), "Parent": root, "Kids": [leaf], "Count": 1, **({"MediaBox": [0, 0, 100 + n["k"], 200]} if n["k"] % 3 else {})}, None)
        kids.append(mid)
    w.objects[root.num] = ({"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 500, 400 + region], "CropBox": [10, 10, 90, 5000]}, None)
    w.objects[cat.num] = ({"Type": Name("Catalog"), "Pages": root}, None)
    w.trailer["Root"] = cat
    return w.bytes()


@registered("""
WITH n AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS page, CASE WHEN n_nationkey % 3 <> 0 THEN 190.0 ELSE 390.0 + n_regionkey END AS h FROM nation)
SELECT n_regionkey AS r_regionkey, CAST(page AS INT) AS page, CAST(CASE WHEN n_nationkey % 2 = 1 THEN 90 ELSE 0 END AS INT) AS rotate, CAST(CASE WHEN n_nationkey % 2 = 1 THEN h ELSE 80 END AS DOUBLE) AS width, CAST(CASE WHEN n_nationkey % 2 = 1 THEN 80 ELSE h END AS DOUBLE) AS height FROM n
""")
def page_geometry(spark, sf):
    d = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct(F.col("n_nationkey").alias("k"))).alias("rows"))
    return view(written(d, _tree, "r_regionkey"), "pages").select("r_regionkey", "page", "rotate", "width", "height")


@registered("""
SELECT s_suppkey AS node, CASE WHEN s_suppkey % 40 <= 32 THEN s_suppkey - s_suppkey % 40 END AS target, CAST(CASE WHEN s_suppkey % 40 <= 32 THEN s_suppkey % 40 END AS INT) AS hops, CASE WHEN s_suppkey % 40 > 32 THEN 'cycle' END AS error FROM supplier
""")
def resolve_refs(spark, sf):
    e = table(spark, sf, "supplier").selectExpr("s_suppkey node", "case when s_suppkey % 40 = 0 then null when s_suppkey % 40 = 39 then s_suppkey else s_suppkey - 1 end next")
    return O.resolve_refs(e)


def _type0(key, name):
    chars = sorted(set(name))
    code = {c: 0x100 + k for k, c in enumerate(chars)}
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n"
    cmap += b"%d beginbfchar\n" % len(chars) + b"".join(b"<%04X> <%04X>\n" % (code[c], ord(c)) for c in chars) + b"endbfchar\n1 beginbfrange <0010> <0019> <0030> endbfrange\n"
    w = C.Writer("flate")
    cat, tree, tu = w.add(None), w.add(None), w.stream(cmap)
    kid = w.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("ABCDEF+Any-BoldItalic"), "DW": 500, "W": [0x100, [600] * len(chars)]})
    font = w.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("ABCDEF+Any-BoldItalic"), "Encoding": Name("Identity-H"), "DescendantFonts": [kid], "ToUnicode": tu})
    text = b"".join(b"%04X" % code[c] for c in name) + b"".join(b"%04X" % (0x10 + int(d)) for d in str(key))
    page = w.add({"Type": Name("Page"), "Parent": tree, "Contents": w.stream(b"BT /F 10 Tf 50 700 Td <" + text + b"> Tj ET")})
    w.objects[cat.num] = ({"Type": Name("Catalog"), "Pages": tree}, None)
    w.objects[tree.num] = ({"Type": Name("Pages"), "Kids": [page], "Count": 1, "Resources": {"Font": {"F": font}}}, None)
    w.trailer["Root"] = cat
    return w.bytes()


@registered("SELECT p_partkey, p_name || p_partkey AS text, TRUE AS bold, TRUE AS italic, CAST(round(50 + 6 * length(p_name) + 5 * length(p_partkey::VARCHAR)) AS BIGINT) AS end_x FROM part")
def tounicode_ranges(spark, sf):
    s = view(written(dealt(table(spark, sf, "part").select("p_partkey", "p_name")), _type0, "p_partkey"), "spans")
    return s.select("p_partkey", "text", "bold", "italic", F.round("end_x").cast("long").alias("end_x"))


def _values(items) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in items)


@registered("SELECT CAST(c AS INT) AS code, chr(CAST(c AS INT)) AS ch FROM range(32, 127) t(c) UNION ALL SELECT CAST(c AS INT), chr(CAST(c AS INT)) FROM range(161, 256) t(c) WHERE c <> 173")
def winansi_table(spark, sf):
    codes = spark.range(32, 256).where("id between 32 and 126 or id > 160 and id != 173").select(F.col("id").cast("int").alias("code"))
    return codes.withColumn("ch", T.decode_bytes(F.array("code"), "WinAnsiEncoding"))


@registered(f"SELECT CAST(code AS INT) AS code, ch FROM (VALUES {_values([(128, 'Ä'), (138, 'ä'), (154, 'ö'), (159, 'ü'), (165, '•'), (174, 'Æ'), (202, chr(160)), (208, '–'), (222, 'ﬁ'), (240, chr(0xF8FF))])}) t(code, ch)")
def macroman_table(spark, sf):
    d = spark.createDataFrame([(c,) for c in (128, 138, 154, 159, 165, 174, 202, 208, 222, 240)], "code int")
    return d.withColumn("ch", T.decode_bytes(F.array("code"), "MacRomanEncoding"))


@registered("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN chr(CAST(192 + n_nationkey AS INT)) ELSE chr(CAST(65 + n_nationkey AS INT)) END AS ch FROM nation")
def glyph_names(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("uni"), F.lpad(F.hex(F.col("n_nationkey") + 192), 4, "0"))).otherwise(F.char(F.col("n_nationkey") + 65)).alias("name"))
    return n.select("n_nationkey", T.glyph_char(F.col("name")).alias("ch"))


@registered("SELECT doc_id, sha256(encode(coalesce(text, ''))) AS sha FROM documents")
def ascii_hex_decode(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), F.lit(" >junk")).alias("h"))
    return d.select("doc_id", F.sha2(T.ascii_hex_decode(F.col("h")), 256).alias("sha"))


@registered("SELECT page_id, replace(html, '|', '\\|') AS escaped FROM pages")
def md_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.md_escape(F.col("html")).alias("escaped"))


@registered("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@registered("SELECT o_orderkey, repeat(' ', CAST(o_orderkey % 3 AS INT)) || '\\' || repeat('#', CAST(1 + o_orderkey % 2 AS INT)) || ' ' || o_orderpriority AS escaped FROM orders")
def hash_escape(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.hash_escape(F.expr("concat(repeat(' ', cast(o_orderkey % 3 as int)), repeat('#', cast(1 + o_orderkey % 2 as int)), ' ', o_orderpriority)")).alias("escaped"))


@registered("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '-' WHEN 1 THEN (o_orderkey % 1000)::VARCHAR WHEN 2 THEN '•' END AS marker FROM orders")
def list_markers(spark, sf):
    line = "case o_orderkey % 4 when 0 then concat('- ', o_orderpriority) when 1 then concat(o_orderkey % 1000, ') ', o_orderpriority) when 2 then concat('  • ', o_orderpriority) else concat('1234. ', o_orderpriority) end"
    return table(spark, sf, "orders").select("o_orderkey", T.list_marker(F.expr(line)).alias("marker"))


@registered("""
WITH b AS (SELECT item_id, encode(text) AS b FROM benchmark), r AS (SELECT item_id, b, unnest(range(0, greatest(0, CAST(ceil(octet_length(b) / 16.0) AS BIGINT)))) AS k FROM b)
SELECT item_id, CAST(k AS BIGINT) AS k, lower(hex(k * 16)) AS at, lower(substr(hex(b), CAST(k * 32 + 1 AS BIGINT), 32)) AS bytes FROM r
""")
def hexdump_rows(spark, sf):
    d = table(spark, sf, "benchmark").select("item_id", F.posexplode(T.hexdump(F.encode("text", "UTF-8"))).alias("k", "line"))
    return d.select("item_id", F.col("k").cast("long").alias("k"), F.expr("lower(hex(cast(conv(left(line, 8), 16, 10) as bigint)))").alias("at"), F.expr("replace(substr(line, 11, 49), ' ', '')").alias("bytes"))


@registered(f"""
WITH p AS (SELECT doc_id FROM documents)
SELECT doc_id, 'header' AS selector, CAST(0 AS BIGINT) AS "start", CAST(8 AS BIGINT) AS length FROM p UNION ALL SELECT doc_id, 'range:5-9', 5, 4 FROM p UNION ALL SELECT doc_id, 'obj:1', 15, CAST(length('1 0 obj') + 1 + length('<< /Type /Catalog /Pages 2 0 R >>') + 1 + 6 AS BIGINT) FROM p WHERE doc_id % 8 <> 6
""")
def selector_spans(spark, sf):
    e = view(_documents(spark, sf), "elements", logical=False, values=False)
    out = O.selectors(table(spark, sf, "documents"), ["header", "range:5-9", "obj:1"], e)  # a range takes no more than the keys
    return out.select("doc_id", "selector", "start", (F.col("end") - F.col("start")).alias("length"))


@registered("SELECT c_custkey, CAST(1 AS BIGINT) AS hits FROM customer WHERE contains(lower(c_mktsegment), 'build')")
def object_search(spark, sf):
    e = view(written(dealt(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")), lambda k, a, b: C.document([b""], "classic", {"Subject": b.encode()}), "c_custkey"), "elements", logical=False)
    return O.search(e.where("kind = 'object'"), "BUILD").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("hits"))


def _trees(spark, sf):
    return view(written(dealt(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")), _info, "c_custkey"), "tree")


@registered("SELECT c_custkey, '%PDF-1.7' AS header, 'Catalog' AS root_type, CAST(1 AS BIGINT) AS pages FROM customer")
def value_tree_paths(spark, sf):
    v = _trees(spark, sf).select("c_custkey", F.parse_json("tree").alias("v"))
    return v.select("c_custkey", F.variant_get("v", "$.header", "string").alias("header"), F.variant_get("v", "$.objects['1 0'].value.Type", "string").alias("root_type"), F.size(F.variant_get("v", "$.pages", "array<variant>")).cast("long").alias("pages"))


@registered("SELECT c_custkey, CAST(0 AS INT) AS seq, '\"' || c_name || '\"' AS output, CAST(NULL AS VARCHAR) AS error FROM customer")
def jq_select(spark, sf):
    return query(_trees(spark, sf), '[.objects[].value | select(type == "object") | select(has("Title"))] | first(.[]) | .Title')


@registered("SELECT c_custkey, CAST(k - 1 AS INT) AS seq, CASE k WHEN 1 THEN '\"Catalog\"' WHEN 2 THEN '1' END AS output, CASE WHEN k = 3 THEN 'stop' END AS error FROM customer, range(1, 4) t(k)")
def jq_error_keeps_outputs(spark, sf):
    return query(_trees(spark, sf), '.objects["1 0"].value.Type, (.pages | length), error("stop")')


def _lossy(key, name):
    pages = [C.text_page([(name, 12, "F1")]), C.text_page([("lost", 12, "F1")])]
    b = C.document(pages, "asciihex")
    return b.replace(b"/ASCIIHexDecode", b"/JBIG2Decode   ", 1) if key % 7 == 0 else b


@registered("SELECT c_custkey, CAST(0 AS INT) AS page, 'PageContents' AS kind, 'UnsupportedFilter' AS cause, 'JBIG2Decode' AS detail, CAST(1 AS BIGINT) AS count FROM customer WHERE c_custkey % 7 = 0")
def skip_report(spark, sf):
    return view(written(dealt(table(spark, sf, "customer").select("c_custkey", "c_name")), _lossy, "c_custkey"), "skips")


@registered("""
WITH i AS (SELECT user_id, event_id % 1000 AS lo, event_id % 1000 + CAST(floor(abs(value)) AS BIGINT) % 20 AS hi FROM events),
m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_lo FROM i)
SELECT user_id, gap_lo, lo AS gap_hi FROM m WHERE lo - gap_lo >= 6
""")
def gutter_gaps(spark, sf):
    return O.gaps(_intervals(spark, sf), ["user_id"], "lo", "hi", 6)


def _intervals(spark, sf):
    return table(spark, sf, "events").selectExpr("user_id", "event_id % 1000 lo", "event_id % 1000 + cast(floor(abs(value)) as bigint) % 20 hi")


@registered("""
WITH i AS (SELECT user_id, event_id % 1000 AS lo, event_id % 1000 + CAST(floor(abs(value)) AS BIGINT) % 20 AS hi FROM events),
m AS (SELECT *, coalesce(lo > max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 6, TRUE) AS new FROM i),
p AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS part FROM m)
SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM p GROUP BY user_id, part
""")
def interval_packing(spark, sf):
    return O.packed(_intervals(spark, sf), ["user_id"], "lo", "hi", 6).select("user_id", "lo", "hi", "n")


@registered("""
WITH h AS (SELECT user_id, event_id AS id, event_id % 97 * 5.0 AS y, event_id % 31 * 10.0 AS x0, event_id % 31 * 10.0 + 60 AS x1 FROM events WHERE event_id % 2 = 0),
v AS (SELECT user_id, event_id AS id, event_id % 89 * 4.0 AS x, event_id % 43 * 10.0 AS y0, event_id % 43 * 10.0 + 80 AS y1 FROM events WHERE event_id % 2 = 1)
SELECT h.user_id, h.id AS h_id, v.id AS v_id FROM h JOIN v ON h.user_id = v.user_id AND x BETWEEN x0 - 6 AND x1 + 6 AND y BETWEEN y0 - 6 AND y1 + 6
""")
def ruling_crossings(spark, sf):
    e = table(spark, sf, "events")
    h = e.where("event_id % 2 = 0").selectExpr("user_id", "event_id id", "event_id % 97 * 5.0D y", "event_id % 31 * 10.0D x0", "event_id % 31 * 10.0D + 60 x1")
    v = e.where("event_id % 2 = 1").selectExpr("user_id", "event_id id", "event_id % 89 * 4.0D x", "event_id % 43 * 10.0D y0", "event_id % 43 * 10.0D + 80 y1")
    return O.crossings(h, v, ["user_id"]).select("user_id", "h_id", "v_id")


@registered("SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS line, CAST(2 AS INT) AS n FROM orders")
def first_fit_lines(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf, "orders").select("o_custkey", n.alias("k"))
    two = o.selectExpr("o_custkey", "k", "explode(array(0, 1)) part").selectExpr("o_custkey", "k * 2 + part seq", "cast(-20 * k + 3 * part as double) y", "10.0D + part size")
    return O.first_fit_lines(two, "o_custkey").select("o_custkey", "line", "n")


def _columns(key, name):
    """By key: two columns; a block wider than tall; three columns; two columns with a wide line between; a right column that is too short."""
    shape, rows = key % 5, [b"BT /F1 10 Tf\n"]
    for k in range(20 if shape == 1 else 40):
        y = 700 - 14 * k - (14 if shape == 3 and k >= 20 else 0)
        for side, x in (("L", 50), ("M", 230), ("R", 410)) if shape == 2 else (("L", 50), ("R", 330)):
            if shape != 4 or side == "L" or k < 12:
                rows.append(b"1 0 0 1 %d %d Tm %s" % (x, y, C.show(f"{side}{k} {name[-4:]} aaaa bbbb cccc")))
    if shape == 3:
        rows.append(b"1 0 0 1 50 %d Tm %s" % (700 - 14 * 20, C.show("W" + " wide" * 15)))
    return C.document([b"".join(rows) + b"ET"], C.FLAVOURS[key % 8])


@registered("""
WITH s AS (SELECT * FROM (VALUES (0, 'L'), (1, 'M'), (2, 'R')) s(o, side), range(0, 40) t(k), range(0, 5) h(shape)),
p AS (SELECT shape, CASE WHEN shape = 0 THEN o * 100 + k WHEN shape = 3 THEN (k // 20) * 10000 + o * 100 + k ELSE k END AS line, o, side || k AS mark FROM s
  WHERE (side <> 'M' OR shape = 2) AND (shape <> 1 OR k < 20) AND (shape <> 4 OR side = 'L' OR k < 12)),
l AS (SELECT c_custkey, line, string_agg(mark || ' ' || right(c_name, 4) || ' aaaa bbbb cccc', ' ' ORDER BY o) AS t FROM customer JOIN p ON c_custkey % 5 = shape GROUP BY 1, 2
  UNION ALL SELECT c_custkey, 9999, 'W' || repeat(' wide', 15) FROM customer WHERE c_custkey % 5 = 3)
SELECT c_custkey, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY 1
""")
def two_column_order(spark, sf):
    return view(written(dealt(table(spark, sf, "customer").select("c_custkey", "c_name")), _columns, "c_custkey"), "document_text")


@registered("SELECT s_suppkey, CAST(s_suppkey + 10 AS DOUBLE) AS x, CAST(2 * s_nationkey - 5 AS DOUBLE) AS y, CAST(s_suppkey AS DOUBLE) AS back_x, CAST(s_nationkey AS DOUBLE) AS back_y FROM supplier")
def matrix_algebra(spark, sf):
    m = G.concat(G.matrix(1, 0, 0, 2, 0, 0), G.matrix(1, 0, 0, 1, 10, -5))
    x, y = G.apply(m, F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double"))
    d = table(spark, sf, "supplier").select("s_suppkey", x.alias("x"), y.alias("y"))
    bx, by = G.apply(G.invert(m), F.col("x"), F.col("y"))
    return d.select("s_suppkey", "x", "y", bx.alias("back_x"), by.alias("back_y"))


@registered("""
WITH b AS (SELECT s_suppkey, s_suppkey % 17 AS a, s_nationkey AS c FROM supplier)
SELECT s_suppkey, CASE WHEN greatest(a, c) < least(a + 10, c + 5) THEN CAST(least(a + 10, c + 5) - greatest(a, c) AS DOUBLE) END AS common, CAST(greatest(a + 10, c + 5) - least(a, c) AS DOUBLE) AS cover, CAST(1 AS DOUBLE) AS turned FROM b
""")
def box_algebra(spark, sf):
    one = F.lit(1.0)
    p, q = G.box(F.expr("s_suppkey % 17"), F.lit(0), F.expr("s_suppkey % 17 + 10"), one), G.box(F.col("s_nationkey"), F.lit(0), F.expr("s_nationkey + 5"), one)
    i, u, t = G.intersect(p, q), G.union(p, q), G.transform(G.matrix(0, 1, -1, 0, 0, 0), p)
    return table(spark, sf, "supplier").select("s_suppkey", (i["x1"] - i["x0"]).alias("common"), (u["x1"] - u["x0"]).alias("cover"), (t["x1"] - t["x0"]).alias("turned"))


def _shapes(key, name):
    return C.document([b"0 0 1 rg 10 10 20 20 re f\n1 0 0 RG 4 w 50 5 m 50 35 l S\n" + C.text_page([(name, 8, "F1")])], "flate", page_attrs={"MediaBox": [0, 0, 80, 40]})


@registered("SELECT n_nationkey, CAST(0 AS INT) AS page, CAST(80 AS INT) AS width, CAST(40 AS INT) AS height, TRUE AS is_png, 'Glyph NoGlyph' AS warnings FROM nation")
def render_shapes(spark, sf):
    r = view(written(table(spark, sf, "nation").select("n_nationkey", "n_name"), _shapes, "n_nationkey"), "png")
    return r.select("n_nationkey", "page", "width", "height", F.startswith(F.hex("png"), F.lit("89504E470D0A1A0A")).alias("is_png"), "warnings")


#: What the boxes of a page of colours show, as RGB bytes by the key k (SQL). Boxes are 10 points wide, in order from the left, the second row above.
_PAINTED = {
    "gray": ("10.2 * k", "10.2 * k", "10.2 * k"), "rgb": ("10.2 * k", "102", "51"), "cmyk": ("(1 - least(1, 0.04 * k + 0.2)) * 255", "204", "204"), "separation": ("255", "255 - 10.2 * k", "255 - 4.08 * k"),
    "indexed": ("k", "255 - k", "10 * k"), "icc": ("51", "10.2 * k", "102"), "smask": ("255 - 10 * k", "255 - 10 * k", "255 - 10 * k"), "alpha": ("191", "191", "191"),
    "multiply": ("102", "10.2 * k * 0.4", "255 * 0.4"), "keyed": ("255", "255", "255"), "stencil": ("51", "102", "10.2 * k"), "devicen": ("255 - 10.2 * k", "255 - 102", "255"), "annotation": ("10.2 * k", "0", "102"),
    "tiled": ("102", "10.2 * k", "0"), "lab": ("255", "255", "255"), "softmask": ("255 - 10.2 * k", "255 - 10.2 * k", "255 - 10.2 * k"),
}


def _colors(k):
    t = k / 25
    n = lambda *v: b" ".join(C.dump(float(x)) for x in v)
    boxes = {
        "gray": n(t) + b" g", "rgb": n(t, 0.4, 0.2) + b" rg", "cmyk": n(t, 0, 0, 0.2) + b" k", "separation": b"/Spot cs " + n(t) + b" scn", "indexed": b"/Table cs %d sc" % k, "icc": b"/Profile cs " + n(0.2, t, 0.4) + b" sc",
        "smask": b"/Soft", "alpha": b"0 g /Quarter gs", "multiply": b"0.4 g", "keyed": b"/Keyed", "stencil": n(0.2, 0.4, t) + b" rg /Stencil", "devicen": b"/Pair cs " + n(t, 0.4) + b" scn", "annotation": b"",
        "tiled": b"/Tinted cs " + n(0.4, t, 0) + b" /Tile scn", "lab": b"/Lab cs 100 0 0 sc", "softmask": b"0 g /Masked gs",
    }

    def at(i, op):
        x, y = i % 8 * 10, i // 8 * 10
        if op.startswith(b"/") and b" " not in op or op.endswith(b"/Stencil"):
            color, _, name = op.rpartition(b"/")
            return b"q %s 10 0 0 10 %d %d cm /%s Do Q\n" % (color, x, y, name)
        return b"q %s %d %d 10 10 re f Q\n" % (op, x, y) if op else b""

    content = b"".join(at(i, op) for i, op in enumerate(boxes.values()))
    x, y = list(boxes).index("multiply") % 8 * 10, 10
    content += b"q %s rg /Times gs %d %d 10 10 re f Q\n" % (n(1, t, 1), x, y)

    def build(w):
        image = lambda data, **attrs: w.stream(data, {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 1, "Height": 1, "BitsPerComponent": 8, **attrs})
        gray = Name("DeviceGray")
        tint = {"FunctionType": 2, "Domain": [0, 1], "C0": [0, 0, 0, 0], "C1": [0, 1, 0.4, 0], "N": 1}
        pair = w.stream(b"{ exch 1 exch sub exch 1 exch sub 1 }", {"FunctionType": 4, "Domain": [0, 1, 0, 1], "Range": [0, 1, 0, 1, 0, 1]})
        form = lambda data, **attrs: w.stream(data, {"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 100, 100], **attrs})
        look = form(b"%s rg 0 0 4 4 re f" % n(t, 0, 0.4), BBox=[0, 0, 4, 4])
        tile = w.stream(b"0 0 3 3 re f", {"PatternType": 1, "PaintType": 2, "TilingType": 1, "BBox": [0, 0, 3, 3], "XStep": 3, "YStep": 3, "Resources": {}})
        group = {"S": Name("Transparency"), "CS": gray}
        ax, ay = list(boxes).index("annotation") % 8 * 10, 10
        return {
            "MediaBox": [0, 0, 80, 20], "Annots": [w.add({"Type": Name("Annot"), "Subtype": Name("Stamp"), "Rect": [ax, ay, ax + 10, ay + 10], "AP": {"N": look}})],
            "Resources": {
                "ColorSpace": {
                    "Spot": [Name("Separation"), Name("Spot"), Name("DeviceCMYK"), tint], "Table": [Name("Indexed"), Name("DeviceRGB"), 24, bytes(v for j in range(25) for v in (j, 255 - j, 10 * j))],
                    "Profile": [Name("ICCBased"), w.stream(b"", {"N": 3})], "Pair": [Name("DeviceN"), [Name("A"), Name("B")], Name("DeviceRGB"), pair], "Tinted": [Name("Pattern"), Name("DeviceRGB")],
                    "Lab": [Name("Lab"), {"WhitePoint": [0.9642, 1, 0.8249]}],
                },
                "XObject": {
                    "Soft": image(b"\0\0\0", ColorSpace=Name("DeviceRGB"), SMask=image(bytes([10 * k]), ColorSpace=gray)), "Keyed": image(bytes([k]), ColorSpace=gray, Mask=[k, k]),
                    "Stencil": image(b"\0", ImageMask=True, BitsPerComponent=1),
                },
                "Pattern": {"Tile": tile},
                "ExtGState": {"Quarter": {"ca": 0.25}, "Times": {"BM": Name("Multiply")}, "Masked": {"SMask": {"S": Name("Luminosity"), "G": form(n(t) + b" g 0 0 100 100 re f", Group=group)}}},
            },
        }

    return C.document([content], C.FLAVOURS[k % 8], build=build)


@registered("WITH n AS (SELECT n_nationkey AS k FROM nation) " + " UNION ALL ".join(f"SELECT k AS n_nationkey, '{name}' AS box, {', '.join(f'CAST(round({v}) AS INT) AS {c}' for c, v in zip('rgb', rgb))} FROM n" for name, rgb in _PAINTED.items()))
def render_colors(spark, sf):
    """The pixel in the middle of each box of colour."""
    px = view(written(table(spark, sf, "nation").select("n_nationkey"), _colors, "n_nationkey"), "pixels").where("x % 10 = 5 and y % 10 = 5")
    names = F.array(*map(F.lit, _PAINTED))
    return px.select("n_nationkey", F.get(names, F.expr("int((1 - y div 10) * 8 + x div 10)")).alias("box"), "r", "g", "b")


def _with_bad_page(key, name):
    """Three pages; what the second shows nests deeper than anything may."""
    return C.document([C.text_page([(f"{name} 1", 12, "F1")]), b"BT /F1 12 Tf " + b"[" * 4000 + b" TJ ET", C.text_page([(f"{name} 3", 12, "F1")])], C.FLAVOURS[key % 8])


@registered("SELECT n_nationkey, page, n_name || ' ' || CAST(page + 1 AS VARCHAR) AS text FROM nation, (SELECT CAST(unnest([0, 2]) AS INT) AS page)")
def good_pages_stay(spark, sf):
    """One bad page among good ones: the good ones' text is there."""
    return view(written(table(spark, sf, "nation").select("n_nationkey", "n_name"), _with_bad_page, "n_nationkey"), "text").where("trim(text) != ''")


def _grid_page(key, name):
    return C.document([C.table_page([["k", name], ["1", "2"], ["3", "4"]], [72, 250], ruled=True)], C.FLAVOURS[key % 8])


@registered("SELECT n_nationkey, CAST(4 AS BIGINT) AS horizontal, CAST(3 AS BIGINT) AS vertical FROM nation")
def ruling_view(spark, sf):
    r = view(written(table(spark, sf, "nation").select("n_nationkey", "n_name"), _grid_page, "n_nationkey"), "rulings")
    return r.groupBy("n_nationkey").agg(F.count_if(F.col("y0") == F.col("y1")).alias("horizontal"), F.count_if(F.col("x0") == F.col("x1")).alias("vertical"))


#: Each operator of a content stream as it is written, and what it is read as: operator, number of operands, first operand as JSON.
_EVERY = [
    *[(f"{v} {op}", op, v.count(" ") + 1, v.split(" ")[0]) for op, v in (
        ("cm", "1 0 0 1 7 8"), ("w", "2"), ("J", "1"), ("j", "2"), ("M", "10"), ("i", "50"), ("m", "3 4"), ("l", "5 6"), ("c", "1 2 3 4 5 6"), ("v", "2 3 4 5"), ("y", "3 4 5 6"), ("re", "4 5 6 7"), ("Tc", "3"), ("Tw", "4"),
        ("Tz", "90"), ("TL", "12"), ("Tr", "1"), ("Ts", "5"), ("Td", "6 7"), ("TD", "7 8"), ("Tm", "1 0 0 1 2 3"), ("d0", "500 0"), ("d1", "500 0 0 0 9 9"), ("SC", "1 2"), ("sc", "2 3"), ("G", "1"), ("g", "0"), ("RG", "1 0 0"),
        ("rg", "0 1 0"), ("K", "1 0 0 0"), ("k", "0 1 0 0"),
    )],
    *[(op, op, 0, None) for op in "q Q h S s f F f* B B* b b* n W W* BT ET T* EMC BX EX".split()],
    *[(f"/{v} {op}", op, 1, f'"{v}"') for op, v in (("ri", "Perceptual"), ("gs", "G0"), ("CS", "DeviceRGB"), ("cs", "DeviceGray"), ("sh", "S0"), ("Do", "X0"), ("MP", "Tag"), ("BMC", "Tag"), ("SCN", "P0"), ("scn", "P1"))],
    ("[3 2] 0 d", "d", 2, "[3,2]"), ("/F1 9 Tf", "Tf", 2, '"F1"'), ("(shown) Tj", "Tj", 1, '"shown"'), ("[(a) -250 (b)] TJ", "TJ", 1, '["a",-250,"b"]'), ("(next) '", "'", 1, '"next"'), ('1 2 (spaced) "', '"', 3, "1"),
    ("/Tag << /K 1 >> DP", "DP", 2, '"Tag"'), ("/Tag /Props BDC", "BDC", 2, '"Tag"'), ("BI /W 1 /H 1 /BPC 8 /CS /G ID x EI", "BI", 1, None),
]


def _every_operator(key, name):
    return C.document(["\n".join(x[0] for x in _EVERY).encode()], C.FLAVOURS[key % 8])


@registered(" UNION ALL ".join("SELECT n_nationkey, CAST({} AS INT) AS seq, '{}' AS op, CAST({} AS INT) AS operands, {} AS first FROM nation".format(k, op.replace("'", "''"), n, "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'") for k, (_, op, n, v) in enumerate(_EVERY)))
def content_operators(spark, sf):
    """Every operator of a content stream, in order, with its operands."""
    ops = view(written(table(spark, sf, "nation").select("n_nationkey", "n_name"), _every_operator, "n_nationkey"), "content_ops")
    return ops.select("n_nationkey", "seq", "op", F.size("operands").alias("operands"), F.when(F.col("op") != "BI", F.get("operands", F.lit(0))).alias("first"))


@registered("""
SELECT n_nationkey, CAST(0 AS BIGINT) AS "offset", 'header' AS label FROM nation UNION ALL SELECT n_nationkey, 15, 'obj 1 0' FROM nation
UNION ALL SELECT n_nationkey, CAST(15 + length('1 0 obj') + 1 + length('<< /Type /Catalog /Pages 2 0 R >>') + 1 + 6 + 1 AS BIGINT), 'obj 2 0' FROM nation
""")
def element_marks(spark, sf):
    """The first boundaries of each file."""
    e = view(written(table(spark, sf, "nation").select("n_nationkey", "n_name"), lambda k, n: C.from_text(n), "n_nationkey"), "elements")
    return O.element_marks(e, "n_nationkey").where("label in ('header', 'obj 1 0', 'obj 2 0')").select("n_nationkey", "offset", "label")


@registered("""
WITH r AS (SELECT item_id, CAST(ceil(octet_length(encode(text)) / 16.0) AS BIGINT) AS n, octet_length(encode(text)) AS size FROM benchmark),
m AS (SELECT item_id, n, size, unnest([0, 20, 21, 32]) AS o FROM r)
SELECT item_id, CAST(o // 16 AS BIGINT) AS k, '── at ' || o || ' ──' AS line FROM m WHERE o <= size AND o < n * 16 UNION ALL SELECT item_id, n, '── at ' || o || ' ──' FROM m WHERE o <= size AND o >= n * 16
UNION ALL SELECT item_id, CAST(unnest(range(0, n)) AS BIGINT), 'row' FROM r
""")
def marked_hexdump(spark, sf):
    """Dumped rows, and before each the marks that lie in it."""
    d = table(spark, sf, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("content"))
    marks = d.select("item_id", F.expr("explode(array(0L, 20L, 21L, 32L))").alias("offset")).withColumn("label", F.concat(F.lit("at "), "offset"))
    return O.marked_hexdump(d, marks, "item_id").select("item_id", F.col("row").alias("k"), F.when(F.col("label").isNull(), "row").otherwise(F.col("line")).alias("line"))


@registered("SELECT n_nationkey, lower(hex(encode('%PDF-1.7'))) AS bytes FROM nation")
def span_bytes(spark, sf):
    """The bytes of a span that a query of the tree gives."""
    d = written(table(spark, sf, "nation").select("n_nationkey", "n_name"), lambda k, n: C.from_text(n), "n_nationkey")
    return d.select("n_nationkey", F.explode(T.result_bytes(F.lit('[{"_span":[0,8]}]'), F.col("content"))).alias("bytes")).select("n_nationkey", F.lower(F.hex("bytes")).alias("bytes"))


@registered("SELECT n_nationkey, n_nationkey % 2 = 0 AS complete FROM nation")
def complete_reports(spark, sf):
    """Documents without skips; every second one has a content stream in a filter that isn't read."""

    def build(k, n):
        return C.document([C.text_page([(n, 12, "F1")])], build=(lambda w: {"Contents": w.add({"Filter": C.Name("JBIG2Decode"), "Length": 1}, b"x")}) if k % 2 else None)

    d = written(table(spark, sf, "nation").select("n_nationkey", "n_name"), build, "n_nationkey")
    return O.complete(d.select("n_nationkey"), view(d, "skips"), "n_nationkey")


@registered("SELECT n_nationkey, 'page' AS ranking, CAST(NULL AS INT) AS level FROM nation WHERE FALSE UNION ALL SELECT n_nationkey, unnest(['document', 'page']) AS ranking, CAST(1 AS INT) AS level FROM nation")
def layout_json(spark, sf):
    """Levels of a page's only large line, ranked over the document and over the page."""
    d = written(table(spark, sf, "nation").select("n_nationkey", "n_name"), lambda k, n: C.document([C.text_page([(n, 20, "F1"), *[("body text", 12, "F1")] * 6])]), "n_nationkey")
    both = [view(d, "layout", ranking=r).select("n_nationkey", F.lit(r).alias("ranking"), F.get_json_object("layout", "$.pages[0].blocks[0].level").cast("int").alias("level")) for r in ("document", "page")]
    return both[0].unionAll(both[1])


@registered("SELECT n_nationkey, n_name, CAST(round(x, 3) AS DOUBLE) AS advance FROM (SELECT n_nationkey, n_name, list_sum([CASE WHEN contains('ABEKPSVXY', c) THEN 667 WHEN contains('CDHNRUw', c) THEN 722 WHEN contains('FTZ', c) THEN 611 WHEN contains('GOQ', c) THEN 778 WHEN c = 'I' OR c = ' ' THEN 278 WHEN contains('0123456789_', c) THEN 556 WHEN c = 'J' THEN 500 WHEN c = 'L' THEN 556 WHEN c = 'M' THEN 833 WHEN c = 'W' THEN 944 END FOR c IN string_split(n_name, '')]) / 1000.0 * 10 AS x FROM nation)")
def standard_widths(spark, sf):
    """The advance of a name in the standard sans face at ten points."""
    d = view(written(table(spark, sf, "nation").select("n_nationkey", "n_name"), lambda k, n: C.document([b"BT /F1 10 Tf 1 0 0 1 0 700 Tm " + C.show(n) + b"ET"]), "n_nationkey"), "spans")
    return d.select("n_nationkey", F.col("text").alias("n_name"), F.round(F.col("end_x") - F.col("x"), 3).alias("advance"))


@registered(f"SELECT doc_id, CAST(len({_LINES}) AS BIGINT) AS lines FROM documents WHERE len({_LINES}) > 0")
def line_view(spark, sf):
    return view(_documents(spark, sf), "lines", columns=("seq",)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


@registered("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'damaged' ELSE 'good' END AS state FROM customer")
def damaged_files(spark, sf):
    d = written(dealt(table(spark, sf, "customer").select("c_custkey", "c_name")), lambda k, n: C.from_text(n)[: 12 if k % 2 == 0 else None], "c_custkey")
    return view(d, "documents").select("c_custkey", F.when(F.col("error").isNull(), "good").otherwise("damaged").alias("state"))


entry = doc_markdown_roundtrip
