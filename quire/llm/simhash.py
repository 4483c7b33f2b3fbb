"""SimHash near-dedup by a Gray-order hierarchical index (operator 10).

Fingerprints that differ in at most d bits agree on one of d + 1 bands. Each distinct fingerprint enters one table for each band, with that band moved to the front, and is dealt there by its
leading bits into buckets of about BUCKET; a bucket over its bound is dealt once more, by bands of the bits that are left. In a bucket all fingerprints are sorted by Gray rank and neighbours are
gathered into nodes, level by level. A node holds the bits that its members share (mask and pattern) without those that a node above holds already. A fingerprint descends from the top and adds up the
differences that it meets; a node is pruned, with all below it, when they exceed d or when its members and the fingerprint are joined already. Links are joined into components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoints, join_often
from .components import components
from .hashing import U64

_LEAF, _FAN, _CHUNK = 8, 8, 1 << 21
#: Fingerprints in a bucket, about; above HOT times that it is dealt again.
BUCKET, HOT = 1 << 14, 4


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits; each is set if it is in over half of the hashes of the word shingles, repeats included."""
    w = text.lower().split()
    if not w:
        return 0
    xxh, joined = xxhash.xxh64_intdigest, b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(w) < width:
        return xxh(joined, 42)
    h = np.array([xxh(joined[a:b], 42) for a, b in zip(starts[: len(w) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], U64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long): the fingerprint of each row's whole text; a null text has that of an empty one, zero."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", width) for x in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fp, U64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(f, "doc_id long, fp long")


def bands(d: int, bits: int = 64) -> list[tuple[int, int]]:
    """First bits and widths of d + 1 bands of the low bits."""
    n = d + 1
    return [(bits * k // n, bits * (k + 1) // n - bits * k // n) for k in range(n)]


def permuted(fp: np.ndarray, first: int, width: int) -> np.ndarray:
    """The fingerprints with a band moved to the front."""
    if width == 64:
        return fp
    low = fp & U64((1 << first) - 1)
    band = (fp >> U64(first)) & U64((1 << width) - 1)
    high = (fp >> U64(first + width)) if first + width < 64 else U64(0) * fp
    return (band << U64(64 - width)) | (high << U64(first)) | low


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order; codes with equal leading bits are neighbours."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U64(s))
    return x


def _depth(n: int, width: int, bucket: int = BUCKET) -> int:
    """So many leading bits part n fingerprints into buckets."""
    return min(width, max(0, math.ceil(math.log2(max(1, n / bucket)))))


def links(fps: DataFrame, n: int, d: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the n distinct fingerprints (column fp) that join all of those at d or fewer differing bits; in a bucket each is tied to the least of those that it reaches."""
    tables = bands(d)
    depth = _depth(n, min(w for _, w in tables), bucket)
    if not depth:
        tables = tables[:1]  # all share the only bucket

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fp = x.column("fp").to_numpy(zero_copy_only=False).view(U64)
            for k, (first, width) in enumerate(tables):
                front = permuted(fp, first, width) >> U64(64 - depth) if depth else np.zeros(len(fp), U64)
                yield pa.RecordBatch.from_arrays([pa.array((front.astype(np.int64) << 8) + k), x.column("fp")], ["bucket", "fp"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "sub", "fp"]
        for x in batches:
            size = x.column("size").fill_null(0).to_numpy()
            cool = pa.array(size == 0)
            yield pa.RecordBatch.from_arrays([x.column("bucket").filter(cool), pa.array(np.full(int((size == 0).sum()), -1)), x.column("fp").filter(cool)], names)
            for many in np.unique(size[size > 0]).tolist():
                hot = np.flatnonzero(size == many)
                name = x.column("bucket").to_numpy()[hot]
                fp = x.column("fp").to_numpy(zero_copy_only=False).view(U64)[hot]
                for k, (first, width) in enumerate(tables):
                    of = np.flatnonzero(name & 255 == k)
                    rest = permuted(fp[of], first, width) << U64(depth)  # what the bucket's members don't share, moved up
                    for j, (low, wide) in enumerate(bands(d, 64 - depth)):
                        take = _depth(many, wide, bucket)
                        part = (rest << U64(64 - depth - low - wide)) >> U64(64 - take) if take else np.zeros(len(of), U64)
                        yield pa.RecordBatch.from_arrays([pa.array(name[of]), pa.array((part.astype(np.int64) << 8) + j), pa.array(fp[of].view(np.int64))], names)

    def joined(t: pa.Table) -> pa.Table:
        k = int(t["bucket"][0].as_py()) & 255
        fp = t["fp"].to_numpy().view(U64)
        x = fp[np.argsort(gray_rank(permuted(fp, *tables[k])))]
        least = Tree(x[:, None], d).labels()
        tied = np.flatnonzero(least != np.arange(len(x)))
        return pa.table({"a": x[tied].view(np.int64), "b": x[least[tied]].view(np.int64)})

    dealt = fps.select("fp").mapInArrow(spread, "bucket long, fp long")
    # a hot bucket has over n / 100000 rows and there are d + 1 tables, so this table has 100000 * (d + 1) rows at most
    hot = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > max(HOT * bucket, n // 100_000))
    dealt = dealt.join(F.broadcast(hot), "bucket", "left").mapInArrow(again, "bucket long, sub long, fp long")
    return dealt.groupBy("bucket", "sub").applyInArrow(joined, "a long, b long")


class Tree:
    """Fingerprints (rows of 64-bit words) in Gray order, in groups that are compared within themselves, with one top node each."""

    def __init__(self, x: np.ndarray, d: int, heads: np.ndarray | None = None):
        self.x, self.d, n = x, d, len(x)
        heads = np.zeros(min(1, n), np.int64) if heads is None else heads
        self.size = np.diff(np.append(heads, n))
        self.top = np.repeat(np.arange(len(heads)), self.size)
        # levels from the leaves up: first members (and one more), first child nodes (and one more), bits all members have, bits any has
        step, count, of = _LEAF, self.size, np.arange(n + 1)
        all_, any_, self.levels = x, x, []
        while True:
            nodes = -(-count // step)
            nth = np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes)
            child = np.append(np.repeat(np.cumsum(count) - count, nodes) + nth * step, count.sum())
            of = of[child]
            all_, any_ = (f.reduceat(z, child[:-1], axis=0) if n else z for f, z in ((np.bitwise_and, all_), (np.bitwise_or, any_)))
            self.levels.append([of, child, all_, ~(all_ ^ any_)])
            if not n or count.max() <= step:
                break
            step, count = _FAN, nodes
        for (*_, mask), (_, child, _, above) in reversed(list(zip(self.levels, self.levels[1:], strict=False))):
            mask &= ~np.repeat(above if above is self.levels[-1][3] else self._whole(above, child), np.diff(child), axis=0)
        self.up = np.arange(n)

    def _whole(self, own: np.ndarray, child: np.ndarray) -> np.ndarray:
        """All bits that the members of these nodes share, those held above too."""
        k = next(i for i, level in enumerate(self.levels) if level[1] is child)
        whole, nodes = own, np.arange(len(own))
        for _, above, _, mask in self.levels[k + 1 :]:
            nodes = np.searchsorted(above, nodes, "right") - 1
            whole = whole | mask[nodes]
        return whole

    def labels(self) -> np.ndarray:
        """For each fingerprint the least place of those that it reaches over differences of d or fewer bits."""
        ends = np.searchsorted(np.cumsum(self.size[self.top]), np.arange(_CHUNK, self.size[self.top].sum() + _CHUNK, _CHUNK)) if len(self.x) else []
        a = 0
        for b in np.unique(np.minimum(np.append(ends, len(self.x)), len(self.x))).tolist():
            if b > a:
                self._unite(*self._near(np.arange(a, b)))
            a = b
        return self.up

    def _near(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (p, later place) at d or fewer differing bits, but for those joined already."""
        node, seen = self.top[q], np.zeros(len(q), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            first, child, pattern, mask = self.levels[k]
            low, high = (f.reduceat(self.up, first[:-1]) for f in (np.minimum, np.maximum))
            seen = seen + _differences((self.x[q] ^ pattern[node]) & mask[node])
            keep = (seen <= self.d) & (first[node + 1] > q + 1) & ~((low[node] == high[node]) & (low[node] == self.up[q]))
            q, node, seen = q[keep], node[keep], seen[keep]
            n = child[node + 1] - child[node]
            lower = np.repeat(child[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            if k:
                q, seen, node = np.repeat(q, n), np.repeat(seen, n), lower
            else:
                q, seen, shared = np.repeat(q, n), np.repeat(seen, n), np.repeat(node, n)
                keep = (lower > q) & (self.up[lower] != self.up[q])
                q, lower, seen, shared = q[keep], lower[keep], seen[keep], shared[keep]
                whole = self._whole(mask, child)
                keep = seen + _differences((self.x[q] ^ self.x[lower]) & ~whole[shared]) <= self.d
                return q[keep], lower[keep]
        return q, node

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            r, s = self.up[a], self.up[b]
            keep = r != s
            a, b, r, s = a[keep], b[keep], r[keep], s[keep]
            np.minimum.at(self.up, np.maximum(r, s), np.minimum(r, s))
            while (self.up != (up := self.up[self.up])).any():
                self.up = up


def _differences(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(1, dtype=np.int64)


def near_dups(docs: DataFrame, d: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of each row: component_id is the least doc_id reachable over fingerprints at d or fewer differing bits.

    docs: doc_id, text. Empty texts and nulls have fingerprint zero and are linked like any other. A row with a null id is linked too, but never names
    a component (its component_id is null if no linked row has an id). Rows of one id are fingerprinted each for itself. An empty table gives an empty table.
    """
    checkpoints(docs.sparkSession)
    rows = fingerprints(docs, width).checkpoint()
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).checkpoint()
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tied = components(links(groups, n, d))
    tied = tied.unionAll(tied.selectExpr("root node", "root").distinct())
    known = tied.join(groups, tied["node"] == groups["fp"]).select("fp", "root", "least")
    named = known.groupBy("root").agg(F.min("least").alias("component"))
    tied = known.join(named, "root").select("fp", "component")
    named = groups.join(tied, "fp", "left").selectExpr("fp", "n", "if(component is null, least, component) component_id").checkpoint()
    return join_often(rows, named, "fp", total).select("doc_id", "fp", "component_id")
