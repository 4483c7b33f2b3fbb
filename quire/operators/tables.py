"""Set-wise operators over the views: merges, trees, references, statistics of spans, running lines, intervals and crossings. DataFrame operations only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_points, hexdump, is_page_number, normalise_line


def merge_sections(entries: DataFrame, doc: str = "doc_id", history: bool = False) -> DataFrame:
    """The newest entry of each object number: that of the lowest section. A max over structs, so it aggregates before it shuffles. history: also all entries, with their sections, so that comparing with them needs no second reading."""
    rest = [c for c in entries.columns if c not in (doc, "num", "section")]
    best = [F.min_by(F.struct(*rest), "section").alias("e"), *([F.collect_list(F.struct("section", *rest)).alias("history")] if history else [])]
    return entries.groupBy(doc, "num").agg(*best).select(doc, "num", *[F.col("e")[c].alias(c) for c in rest], *(["history"] if history else []))


def last_definition(objects: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Recovery: of several definitions of a number the one at the highest offset."""
    rest = [c for c in objects.columns if c not in (doc, "num")]
    return objects.groupBy(doc, "num").agg(F.max_by(F.struct(*rest), "offset").alias("e")).select(doc, "num", *[F.col("e")[c].alias(c) for c in rest])


def resolve_refs(edges: DataFrame, most: int = 32) -> DataFrame:
    """(node, target, hops, error) where edges (node, next) is null at a value: chains are followed by pointer doubling, so `most` hops need its logarithm of joins. A chain that is longer, or a cycle, is an error; a missing node is null."""
    cur = edges.select("node", F.col("next").alias("at"), F.when(F.col("next").isNull(), 0).otherwise(1).alias("hops"))
    step = cur
    for _ in range(max(1, most.bit_length())):
        b = step.select(F.col("node").alias("b_node"), F.col("at").alias("b_at"), F.col("hops").alias("b_hops"))
        hop = step.join(b, step["at"] == b["b_node"], "left")
        step = hop.select("node", F.when(F.col("b_at").isNull(), F.col("at")).otherwise(F.col("b_at")).alias("at"), (F.col("hops") + F.coalesce("b_hops", F.lit(0))).alias("hops"))
    bad = F.col("hops") > most
    return step.select("node", F.when(~bad, F.coalesce("at", "node")).alias("target"), F.when(~bad, F.col("hops")).alias("hops"), F.when(bad, F.lit("cycle")).alias("error"))


def inherit(nodes: DataFrame, attrs: list[str], most: int = 1 << 20) -> DataFrame:
    """(node, depth, attributes, error): each attribute is the node's own or that of the nearest ancestor. nodes: node, parent and attributes.

    Ancestors are reached by doubling, so the joins grow with the logarithm of the depth; where `most` levels leave a parent, as in a cycle, error says so.
    """
    cur = nodes.select("node", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"), *attrs)
    for _ in range(most.bit_length()):
        if cur.where("up is not null").isEmpty():
            break
        over = cur.select(F.col("node").alias("p_node"), F.col("up").alias("p_up"), F.col("depth").alias("p_depth"), *[F.col(a).alias(f"p_{a}") for a in attrs])
        step = cur.join(over, F.col("up") == F.col("p_node"), "left")
        cur = step.select("node", F.col("p_up").alias("up"), (F.col("depth") + F.coalesce("p_depth", F.lit(0))).alias("depth"), *[F.coalesce(a, f"p_{a}").alias(a) for a in attrs])
    cur = cur.withColumn("error", F.when(F.col("up").isNotNull(), "too deep")).withColumn("depth", F.col("depth").cast("int"))
    return cur.drop("up")


def size_histogram(spans: DataFrame, *keys: str) -> DataFrame:
    """Characters other than white space by half-point size."""
    chars = F.length(F.regexp_replace("text", r"\s", ""))
    return spans.groupBy(*keys, half_points(F.col("size")).alias("half_points")).agg(F.sum(chars).cast("long").alias("chars"))


def size_ladder(histogram: DataFrame, *keys: str) -> DataFrame:
    """Body size of each document (most characters, the smaller of equals) and the level of each larger size: its rank, 6 at most."""
    # over a window, not joined: what the histogram is made of is read once
    body = F.min_by("half_points", F.struct(-F.col("chars"), F.col("half_points"))).over(Window.partitionBy(*keys))
    big = histogram.withColumn("body", body).where("half_points >= body + 2")
    level = F.least(F.lit(6), F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("half_points"))))
    return big.select(*keys, "body", "half_points", level.cast("int").alias("level"))


def running_lines(edges: DataFrame, doc: str = "doc_id", near: float = 2.0) -> DataFrame:
    """Of each page's edge line (doc, page, text, y, pages): is it a running line. A page number, or the same normalised text at the same height on half the pages and three at least."""
    e = edges.withColumn("norm", normalise_line(F.col("text")))
    w = Window.partitionBy(doc, "norm").orderBy(F.round(F.col("y") * 1000).cast("long")).rangeBetween(-int(near * 1000), int(near * 1000))
    return e.withColumn("running", (F.col("pages") >= 3) & (is_page_number(F.col("text")) | (F.count(F.lit(1)).over(w) >= F.greatest(F.lit(3), F.floor(F.col("pages") / 2))))).drop("norm")


def gaps(intervals: DataFrame, keys: list[str], lo: str, hi: str, least: float) -> DataFrame:
    """Holes of at least `least` between the intervals of a key: one ordered pass with a running maximum."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("gap_lo", reach).where(F.col(lo) - F.col("gap_lo") >= least).select(*keys, "gap_lo", F.col(lo).alias("gap_hi"))


def packed(intervals: DataFrame, keys: list[str], lo: str, hi: str, near: float = 0.0) -> DataFrame:
    """Intervals that overlap or nearly meet, merged."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    new = F.coalesce(F.col(lo) > F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)) + near, F.lit(True))
    # equal intervals are peers, whatever order a sort leaves them in: the sum reaches to the last of them
    marked = intervals.withColumn("new", new.cast("int")).withColumn("part", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "part").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("n"))


def crossings(horizontal: DataFrame, vertical: DataFrame, keys: list[str], near: float = 6.0) -> DataFrame:
    """Pairs of lines of a page that meet: horizontal (id, y, x0, x1), vertical (id, x, y0, y1)."""
    h = horizontal.select(*keys, F.col("id").alias("h_id"), "y", "x0", "x1")
    v = vertical.select(*keys, F.col("id").alias("v_id"), "x", "y0", "y1")
    return h.join(v, keys).where((F.col("x").between(F.col("x0") - near, F.col("x1") + near)) & (F.col("y").between(F.col("y0") - near, F.col("y1") + near)))


def first_fit_lines(spans: DataFrame, *keys: str) -> DataFrame:
    """Line groups of each page, by a fold over its spans in order: a span joins the first group whose baseline is within half the larger size."""
    s = F.sort_array(F.collect_list(F.struct("seq", "y", "size")))
    fits = lambda g, x: F.abs(g["y"] - x["y"]) <= 0.5 * F.greatest(g["size"], x["size"])
    empty = F.array().cast("array<struct<y:double,size:double,n:int>>")

    def add(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda g: fits(g, x)), F.lit(True))
        grown = F.transform(acc, lambda g, i: F.when(i == at - 1, F.struct(g["y"].alias("y"), F.greatest(g["size"], x["size"]).alias("size"), (g["n"] + 1).alias("n"))).otherwise(g))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(F.struct(x["y"].alias("y"), x["size"].alias("size"), F.lit(1).alias("n")))))

    out = spans.groupBy(*keys).agg(F.aggregate(s, empty, add).alias("groups"))
    return out.select(*keys, F.posexplode(F.sort_array("groups", asc=False)).alias("line", "g")).select(*keys, "line", "g.y", "g.size", "g.n")


def search(elements: DataFrame, needle: str) -> DataFrame:
    """Elements whose number, keys, names or strings hold the text, in any case."""
    hay = F.lower(F.concat_ws(" ", F.col("ref.num").cast("string"), "kind", "value"))
    return elements.where(F.contains(hay, F.lit(needle.lower())))


def selector(df: DataFrame, text: str, elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end) of a selector in each document: header, trailer, startxref, eof, obj:N[,G], xref:N or range:A-B."""
    kind, _, arg = text.partition(":")
    if kind == "range":
        a, _, b = arg.partition("-")
        return df.select(key, F.lit(int(a, 0)).cast("long").alias("start"), F.lit(int(b, 0)).cast("long").alias("end"))
    e = elements.where("span is not null")
    if kind == "obj":
        e = e.where(_chosen(text))
    elif kind in ("xref", "trailer"):
        nth = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
        e = e.where(F.col("kind") == "xref").withColumn("nth", nth).where(F.col("nth") == (int(arg) if arg else 1))
    elif kind in ("header", "startxref", "eof"):
        e = e.where(_chosen(text))
    else:
        raise ValueError(f"unknown selector {text!r}")
    return e.select(key, F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def _chosen(text: str) -> Column:
    """Does a selector that needs one element alone choose it?"""
    kind, _, arg = text.partition(":")
    if kind != "obj":
        return F.col("kind") == kind
    n, _, g = arg.partition(",")
    chosen = (F.col("kind") == "object") & (F.col("ref.num") == int(n))
    return chosen & (F.col("ref.gen") == int(g)) if g else chosen


def selectors(df: DataFrame, texts: list[str], elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, selector, start, end) of several selectors: those that need one element alone share one reading of the elements."""
    shared = [t for t in texts if t.partition(":")[0] in ("obj", "header", "startxref", "eof")]
    out = [selector(df, t, elements, key).select(key, F.lit(t).alias("selector"), "start", "end") for t in texts if t not in shared]
    if shared:
        hits = F.array_compact(F.array(*[F.when(_chosen(t), F.lit(t)) for t in shared]))
        e = elements.where("span is not null").select(key, F.explode(hits).alias("selector"), F.col("span.start").alias("start"), F.col("span.end").alias("end"))
        out.append(e)
    return functools.reduce(DataFrame.unionAll, out)


def element_marks(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, offset, label): where the physical elements of each document begin; members of object streams have no boundary of their own."""
    kind, entries = F.col("kind"), F.get_json_object("value", "$.entries")
    label = (
        F.when(kind == "object", F.concat_ws(" ", F.lit("obj"), F.col("ref.num").cast("string"), F.col("ref.gen").cast("string")))
        .when(kind == "xref", F.concat(F.lit("xref"), F.coalesce(F.concat(F.lit(" ("), entries, F.lit(" entries)")), F.lit("")))).otherwise(kind)
    )
    physical = elements.where(F.col("span").isNotNull() & F.col("in_objstm").isNull() & kind.isin("header", "object", "xref", "trailer", "startxref", "eof"))
    return physical.select(key, F.col("span.start").alias("offset"), label.alias("label"))


def marked_hexdump(df: DataFrame, marks: DataFrame, key: str = "doc_id", content: str = "content", width: int = 16) -> DataFrame:
    """(key, row, label, line): rows of a hexdump, and before each the marks (key, offset, label) that lie in it; a mark at the end follows the last row. Ordered by key, row, label first and offset."""
    lines = df.select(key, F.octet_length(content).cast("long").alias("size"), F.posexplode(hexdump(F.col(content), width)).alias("at", "line"))
    rows = lines.select(key, F.col("at").cast("long").alias("row"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("offset"), "line")
    sized = marks.join(df.select(key, F.octet_length(content).cast("long").alias("size")), key).where(F.col("offset").between(0, F.col("size")))
    last = F.ceil(F.col("size") / width).cast("long")
    heads = sized.select(key, F.least(F.expr(f"offset div {width}"), last).alias("row"), "label", "offset", F.concat(F.lit("── "), "label", F.lit(" ──")).alias("line"))
    return rows.unionByName(heads).orderBy(key, "row", F.col("offset").asc_nulls_last())


def complete(documents: DataFrame, skips: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, complete): is nothing of a document skipped?"""
    return documents.select(key).join(skips.select(key).distinct().withColumn("complete", F.lit(False)), key, "left").withColumn("complete", F.coalesce("complete", F.lit(True)))
