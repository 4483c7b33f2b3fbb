"""Near copies by exact Jaccard similarity of word shingles (second stage of the pipeline).

SimHashes of 64 bits and a radius of two find next to none of the pairs at similarity 0.8, so this stage has its own: 256 bits over the distinct shingles, of which such pairs differ in about 39.
Each fingerprint enters one table for each band of FRONT bits, in DEALS shuffles of the bits; below equal bands lies the Gray-order tree of simhash.py, over all 256 bits and for RADIUS.
At similarity 0.8 a band agrees with probability 0.14, so the 42 tables miss about one pair in 500, and fewer above. What the tables tie is confirmed: within each
candidate component all pairs of shingle sets that can still join two groups are compared, so a link always means a similarity of 0.8 or more (of 64-bit shingle hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoints, join_often
from .components import components
from .hashing import U64, batches, buffers, mix, runs_of, word_hashes, words
from .simhash import Tree, gray_rank

WIDTH, RADIUS, FRONT, DEALS = 5, 72, 12, 2
#: A link needs NEAR[0] / NEAR[1] or more.
NEAR = (4, 5)
_SALTS = mix(np.arange(1, 5, dtype=U64))
_BANDS = [band for deal in range(DEALS) for band in np.random.RandomState(deal).permutation(256)[: 256 // FRONT * FRONT].reshape(-1, FRONT)]
_FP, _ROWS = ("f0", "f1", "f2", "f3"), 1 << 14


def shingle_sets(column, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of `width` words (A-Z lower-cased); a shorter text is one run, one without words (or null) has none."""
    data, off = buffers(column)
    for a, b in batches(off):
        part = data[off[a] : off[b]].copy()
        part[(part >= 65) & (part <= 90)] += 32
        starts, ends, first = words(part, off[a : b + 1] - off[a])
        h = word_hashes(part, starts, ends)
        for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(runs_of(h[p:q], min(width, q - p))) if q > p else h[:0]


def wide(s: np.ndarray) -> np.ndarray:
    """256 bits (four words); each is set if it is in over half of the hashes."""
    ones = np.zeros(256, np.int64)
    for a in range(0, len(s), _ROWS):
        ones += np.unpackbits(mix(s[a : a + _ROWS, None] + _SALTS).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(s), bitorder="little").view(U64)


def node(s: np.ndarray) -> int:
    """Equal for equal sets; a signed 64-bit hash."""
    return int(np.array(xxhash.xxh64_intdigest(s.tobytes(), 42), U64).view(np.int64))


def with_nodes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows with the node of their text."""

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([node(s) for s in shingle_sets(b.column("text"), width)], pa.int64())], [*b.schema.names, "node"])

    return docs.mapInArrow(f, docs.drop("node").withColumn("node", F.lit(0).cast("long")).schema)


def _prints(docs: DataFrame, width: int) -> DataFrame:
    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            nodes, fps = [], np.zeros((b.num_rows, 4), U64)
            for k, s in enumerate(shingle_sets(b.column("text"), width)):
                nodes.append(node(s))
                fps[k] = wide(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(nodes, pa.int64()), *(pa.array(fps[:, k].copy().view(np.int64)) for k in range(4))], ["doc_id", "node", *_FP])

    return docs.select("doc_id", "text").mapInArrow(f, "doc_id long, node long, f0 long, f1 long, f2 long, f3 long")


def fronts(fp: np.ndarray) -> Iterator[np.ndarray]:
    """Of each table the number of the top node that each fingerprint has there; no two tables share one."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    weights = 1 << np.arange(FRONT)
    for k, band in enumerate(_BANDS):
        yield ((k << FRONT) + bits[:, band].astype(np.int64) @ weights).astype(np.int32)


def candidates(prints: DataFrame) -> DataFrame:
    """(a, b): nodes at RADIUS or fewer differing bits that share a band; links that join all of these, not all pairs of a dense group.

    Below a top node, each node is tied to the least that it reaches. Over all tables a node keeps its least one, to which the others (as many as tables at most) are tied in its place, so that
    a dense group costs one link for each node and those between its few least nodes.
    """

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            for top in fronts(_matrix(x)):
                yield pa.RecordBatch.from_arrays([pa.array(top), x.column("node"), *(x.column(k) for k in _FP)], ["top", "node", *_FP])

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for x in parts:
            x = pa.Table.from_batches([x])
            x = pa.concat_tables([rest, x]).combine_chunks() if rest is not None else x
            top = x["top"].to_numpy()
            new = np.flatnonzero(top[1:] != top[:-1]) + 1
            cut = int(new[-1]) if len(new) else 0
            yield _tied(x.slice(0, cut))
            rest = x.slice(cut)
        if rest is not None:
            yield _tied(rest)

    dealt = prints.select("node", *_FP).mapInArrow(spread, "top int, node long, f0 long, f1 long, f2 long, f3 long").repartition("top")
    stars = dealt.sortWithinPartitions("top").mapInArrow(joined, "a long, b long").groupBy("a").agg(F.collect_set("b").alias("hubs"), F.min("b").alias("b"))
    return stars.selectExpr("explode(array_union(hubs, array(a))) a", "b").where("a != b").distinct()


def _matrix(x) -> np.ndarray:
    return np.stack([np.asarray(x.column(k)).view(U64) for k in _FP], axis=1) if x.num_rows else np.zeros((0, 4), U64)


def _tied(rows: pa.Table) -> pa.RecordBatch:
    top, x = rows["top"].to_numpy(), _matrix(rows)
    order = np.lexsort((gray_rank(x[:, 0]), top))
    top, nodes, x = top[order], rows["node"].to_numpy()[order], x[order]
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(top)), bool), top[1:] != top[:-1]]))
    up = Tree(x, RADIUS, heads).labels()
    least = np.full(len(top), np.iinfo(np.int64).max)
    np.minimum.at(least, up, nodes)
    a = np.flatnonzero(least[up] != nodes)
    return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(least[up][a])], ["a", "b"])


def confirmed(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least place of those that it reaches over pairs of similarity NEAR or more."""
    up = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    off = np.concatenate([[0], np.cumsum(sizes)])
    near = lambda both, m, n: both * (NEAR[0] + NEAR[1]) >= NEAR[0] * (m + n)
    words_, flat = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.zeros(0, U64), np.zeros(0, np.int64))
    mark = np.zeros(len(words_), bool)
    for k in range(1, len(sets)):
        mine = flat[off[k] : off[k + 1]]
        mark[mine] = True
        for at in (np.arange(max(0, k - 8), k), np.arange(k)):  # one link often settles all
            at = at[(up[at] != up[k]) & near(np.minimum(sizes[at], sizes[k]), sizes[at], sizes[k])]
            both = np.array([np.count_nonzero(mark[flat[off[i] : off[i + 1]]]) for i in at.tolist()], np.int64)
            for r in np.unique(up[at[near(both, sizes[at], sizes[k])]]).tolist():
                up[up == max(r, up[k])] = min(r, up[k])
        mark[mine] = False
    return up


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Of each group of near copies one row: that of least doc_id, then least hash of the whole row; rows without an id come last. Of rows that are equal in all columns one is left.

    docs: doc_id, text and any others. What is compared are rows, not ids: a text that no other is like stays, whatever other rows have its id. Empty texts and nulls are copies of each other.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]).alias("row"))
    keyed = docs.withColumn("own_key", key)
    copies = near_copies(docs.select("doc_id", "text"), width)
    rows = with_nodes(keyed.select("text", "own_key"), width).select("own_key", "node").checkpoint()
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    rooted = join_often(rows, counts.join(copies.select("node", "root"), "node"), "node", total)
    found = rooted.groupBy("root", "own_key").agg(F.count(F.lit(1)).alias("same"))
    least = found.groupBy("root").agg(F.min(F.struct("own_key", "same")).alias("least"), F.sum("same").alias("n")).where("n > 1").select("root", "least", "n").checkpoint()
    # rows of groups of one row aren't looked at again
    gone = join_often(found, least.select("root", "n", "least"), "root", total).where("own_key != least.own_key").select("own_key").distinct()
    twice = least.where("least.same > 1").selectExpr("least.own_key own_key")
    kept = keyed.join(gone, "own_key", "left_anti")
    once, several = kept.join(twice, "own_key", "left_anti"), kept.join(twice, "own_key", "left_semi").dropDuplicates(["own_key"])
    return once.unionByName(several).select(*[f"`{c}`" for c in docs.columns])


def near_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, root, least) of each node: root is one for each component of near copies, least the least doc_id of the node's rows.

    docs: doc_id, text. Rows of equal shingle sets share a node (empty texts and nulls too). A node's text is compared in one task with those of its candidate component.
    """
    checkpoints(docs.sparkSession)
    prints = _prints(docs, width).groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), *(F.first(k).alias(k) for k in _FP)).checkpoint()
    tied = components(candidates(prints))
    tied = tied.unionAll(tied.selectExpr("root node", "root").distinct())
    total = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # the rows of a node have the same shingles; a task sends one of them on
    texts = join_often(with_nodes(docs.select("text"), width), tied.join(prints.select("node", "n"), "node"), "node", total).dropDuplicates(["node"])

    def exact(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        up = confirmed(list(shingle_sets(t["text"], width)))
        nodes = t["node"].to_numpy()
        several = np.bincount(up, minlength=len(up))[up] > 1
        return pa.table({"node": pa.array(nodes[several]), "root": pa.array(nodes[up][several])})

    roots = texts.groupBy("root").applyInArrow(exact, "node long, root long")
    return prints.select("node", "least").join(roots, "node", "left").selectExpr("node", "coalesce(root, node) root", "least").checkpoint()
