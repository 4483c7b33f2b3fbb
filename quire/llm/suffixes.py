"""Suffix dedup by a depth-limited radix sort (operator 1).

Suffixes are ordered only through their first `size` bytes, and only those that can have an equal elsewhere:

* each suffix belongs to the least hash among the 16-byte strings in its window, and neighbours share it; suffixes whose least string no other document has are alone and are dropped;
* what is left goes to the part that owns its least string, as fragments of text: a run of neighbouring suffixes is one fragment, and a block sends equal fragments once;
* a part deals its suffixes by a digit of their first and last eight bytes, then orders each bucket by most-significant-digit passes of eight bytes through the full depth. Groups that
  are left are equal byte by byte: they are the repeated windows, and the member in the smallest document stays.

Hashes only choose what is compared and where; they miss no repeat and decide none. Texts move once, a hot window costs one fragment for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import hashing as H
from .radix import equal_groups

_ANCHOR = 16
#: Bytes of text in a block: hashes take eight times as much.
BLOCK_BYTES = 4 << 20


class _Block:
    """The suffixes of a block's documents with `size` bytes in their row, as runs of neighbours that share their least string."""

    def __init__(self, t: pa.Table, size: int, bits: int):
        self.t, self.size = B.in_order(t), size
        self.data, self.off = H.buffers(self.t["text"])
        self.rank = B.ranks(self.t)
        start, count, least, doc = [], [], [], []
        for lo, hi in H.batches(self.off):
            base = int(self.off[lo])
            data = self.data[base : self.off[hi]]
            ends = self.off[lo : hi + 1] - base
            if len(data) < size:
                continue
            owner = np.repeat(np.arange(hi - lo), np.diff(ends))[: len(data) - size + 1]
            pos = np.flatnonzero(np.arange(len(owner)) + size <= ends[1:][owner])
            if not len(pos):
                continue
            anchor = H.byte_windows(data, _ANCHOR)[0]
            low, o = H.sliding_min(anchor, size - _ANCHOR + 1)[pos], owner[pos]
            new = np.ones(len(pos), bool)  # a suffix that begins with the least string is the last that holds it there
            new[1:] = (low[1:] != low[:-1]) | (o[1:] != o[:-1]) | (anchor[pos[:-1]] == low[:-1])
            heads = np.flatnonzero(new)
            start.append(base + pos[heads])
            count.append(np.diff(np.append(heads, len(pos))))
            least.append(H.mix(low[heads]) >> H.U64(64 - bits))  # mixed anew: least hashes are small
            doc.append(self.rank[lo + o[heads]])
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.count, self.least, self.doc = cat(start, np.int64), cat(count, np.int64), cat(least, H.U64), cat(doc, np.int64)

    def digits(self) -> np.ndarray:
        """Distinct least strings; notes which several documents here have, and each run's own."""
        keys, one, self.which = np.unique(self.least, return_index=True, return_inverse=True)
        self.several = np.zeros(len(keys), bool)
        self.several[self.which[self.doc != self.doc[one][self.which]]] = True
        return keys

    def fragments(self, replies: pa.Table, bits: int, parts: int) -> None:
        """Of the runs that may have an equal: the distinct fragment of each; of each fragment its text, part and first document here. Fragments are ordered by part."""
        keys = self.digits()
        self.open = np.flatnonzero((B.told(replies, 1, keys, bits, parts)[0] | self.several)[self.which]) if len(keys) else np.zeros(0, np.int64)
        raw, number, more = self.data.tobytes(), {}, self.size - 1
        own = np.array([number.setdefault(raw[a : a + n + more], len(number)) for a, n in zip(self.start[self.open].tolist(), self.count[self.open].tolist(), strict=True)], np.int64)
        first = np.unique(own, return_index=True)[1]
        part = B.part_of(self.least[self.open][first], bits, parts)
        order = np.argsort(part, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        texts = list(number)
        self.own, self.texts, self.part, self.first = back[own], [texts[k] for k in order.tolist()], part[order], self.doc[self.open][first][order]


def dedup_suffixes(docs: DataFrame, size: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each byte covered by a `size`-byte string that also starts in a document of smaller doc_id is cut.

    docs: doc_id, text. Strings are judged on the input and never cross rows; size is 17 or more; kept (binary) joins the other bytes and may split a character.
    A null text is empty; a null doc_id counts as the least; rows of one doc_id don't count against each other. An empty table gives an empty table.
    """
    texts, all_ = B.blocked(docs.select("doc_id", "text"), block_bytes)
    bits, parts = B.bits_for(all_["bytes"]), all_["parts"]

    def first(block: int, t: pa.Table) -> pa.Table:
        return B.ask(block, 1, _Block(t, size, bits).digits(), bits, parts)

    def second(block: int, t: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(t, size, bits)
        b.fragments(replies, bits, parts)
        used, begin = np.unique(b.part, return_index=True)
        blobs = []
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(b.part)][: len(used)], strict=True):
            lengths = np.fromiter(map(len, b.texts[lo:hi]), np.uint16, hi - lo)
            blobs.append(B.zipped(np.uint32(hi - lo).tobytes() + lengths.tobytes() + b.first[lo:hi].astype(np.uint32).tobytes() + b"".join(b.texts[lo:hi])))
        return B.rows_for(block, 2, used.tolist(), blobs)

    def cut(block: int, t: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(t, size, bits)
        b.fragments(replies, bits, parts)
        windows = np.fromiter(map(len, b.texts), np.int64, len(b.texts)) - (size - 1)
        begin = np.concatenate([[0], np.cumsum(windows)])
        edge = np.concatenate([[0], np.cumsum(np.bincount(b.part, windows, parts).astype(np.int64))])
        earlier = np.zeros(begin[-1], bool)
        for p, a, _ in B.rows_of(replies, 2):
            earlier[edge[p] : edge[p + 1]] = np.unpackbits(np.frombuffer(a, np.uint8), count=int(edge[p + 1] - edge[p]))
        # of each open run's suffixes: a smaller document has them, be it in another block or here
        n = b.count[b.open]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        again = np.repeat(b.doc[b.open] > b.first[b.own], n) if len(n) else np.zeros(0, bool)
        gone = np.zeros(len(b.data), bool)
        gone[np.repeat(b.start[b.open], n) + within] = again | earlier[np.repeat(begin[b.own], n) + within]
        cover = np.zeros(len(b.data) + 1, np.int32)
        cover[:-1] += gone
        cover[size:] -= gone[: max(0, len(gone) - size + 1)]
        out = np.cumsum(cover)[:-1] > 0
        before = np.zeros(len(out) + 1, np.int64)
        np.cumsum(out, out=before[1:])
        begins = out.copy()
        begins[1:] &= ~out[:-1]
        edge = b.off[:-1][b.off[:-1] < len(out)]
        begins[edge] = out[edge]
        spans = np.zeros(len(out) + 1, np.int64)
        np.cumsum(begins, out=spans[1:])
        rest, kept_at = b.data[~out].tobytes(), b.off - before[b.off]
        kept = [rest[x:y] for x, y in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)]
        return pa.table({"doc_id": b.t["doc_id"], "n_bytes": np.diff(b.off), "n_removed": np.diff(before[b.off]), "n_spans": np.diff(spans[b.off]), "kept": pa.array(kept, pa.binary())})

    one = B.answers(B.first_ask(texts, first))
    two = B.answers(B.with_answers(texts, one, second), lambda t: _repeated(t, size))
    return B.with_answers(texts, one.unionAll(two), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _repeated(asked: pa.Table, size: int) -> pa.Table:
    """The answers of a part: a bit for each suffix of each block's fragments, is there an equal one in a smaller document."""
    asked = asked.sort_by("block")
    data, lengths, place = [], [], []
    for block, x in zip(asked["block"].to_pylist(), asked["asked"], strict=True):
        raw = B.unzipped(x.as_buffer().to_pybytes())
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        lengths.append(np.frombuffer(raw, np.uint16, n, 4).astype(np.int64))
        place.append((block << 32) + np.frombuffer(raw, np.uint32, n, 4 + 2 * n).astype(np.int64))
        data.append(raw[4 + 6 * n :])
    sizes = [int((x - size + 1).sum()) for x in lengths]
    n = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    place, windows = np.concatenate(place) if place else n, n - size + 1
    text = np.frombuffer(b"".join(data) + bytes(8), np.uint8)
    del data
    many = windows.sum()
    at = np.repeat(np.cumsum(n) - n, windows) + np.arange(many) - np.repeat(np.cumsum(windows) - windows, windows)
    bucket = H.mix(H.eight_at(text, at) * H.U64(0x9E3779B97F4A7C15) + H.eight_at(text, at + size - 8)) if many else np.zeros(0, H.U64)
    steps = [min(k, size - 8) for k in range(0, size, 8)]
    members, group = equal_groups(bucket, lambda k, of: H.eight_at(text, at[of] + steps[k]), len(steps))
    earlier = np.zeros(many, bool)
    if len(members):
        mine = np.repeat(place, windows)[members]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        earlier[members] = np.minimum.reduceat(mine, heads)[group] < mine
    edge = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    out = [np.packbits(earlier[a:b]).tobytes() for a, b in zip(edge, edge[1:], strict=False)]
    return asked.set_column(3, "asked", pa.array(out, pa.binary())).set_column(4, "more", pa.array([b""] * len(out), pa.binary()))
