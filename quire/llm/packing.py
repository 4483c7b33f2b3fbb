"""Packing into sequences by Karmarkar-Karp multiway differencing (operator 6).

Documents are cut into full sequences and a rest, and a long rest into a few nearly equal pieces. The pieces of a run of documents are dealt into
windows: two partial partitions are merged at a time, those of largest imbalance first, the fullest windows of one onto the emptiest of the other, which gives
nearly equal windows. Their number starts at the least that can hold all and rises, with the differencing done anew, whenever a window exceeds its capacity.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import _SYNC

#: Documents packed together. More give fuller windows; memory and work grow with it, and not with the table.
RUN_DOCS = 512
#: Characters tokenized at once.
_LONG = 1 << 16
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """The items (of one or more each) of k nearly equal windows, by multiway differencing."""
    # a partition is (sums in falling order, node of each) of its windows that aren't empty; a node is an item or the union of two nodes
    kids: list[tuple[int, int]] = []
    n = len(sizes)
    heap = [(-s if k > 1 else 0, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:  # the emptiest windows of one take the fullest of the other
            total, node = np.concatenate([a, np.zeros(k - len(a), a.dtype)]), np.concatenate([x, np.full(k - len(x), -1)])
            total[k - len(b) :] += b[::-1]
            both = np.arange(k - len(b), len(a))
            node[len(a) :] = y[::-1][len(y) - (k - len(a)) :]
            node[both] = n + len(kids) + np.arange(len(both))
            kids += zip(x[both].tolist(), y[::-1][: len(both)].tolist(), strict=True)
        else:
            total, node = np.concatenate([a, b]), np.concatenate([x, y])
        if over > 0 or b[0] > a[-1]:
            order = np.argsort(-total, kind="stable")
            total, node = total[order], node[order]
        heapq.heappush(heap, (int((total[-1] if len(total) == k else 0) - total[0]), turn, total, node))
        turn += 1
    out = []
    for top in (heap[0][3].tolist() if heap else []):
        items, stack = [], [top]
        while stack:
            v = stack.pop()
            if v < n:
                items.append(v)
            else:
                stack += kids[v - n]
        out.append(sorted(items))
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """The items of each window; no item may exceed the capacity. As few windows as hold all, and one more for each time that differencing leaves one above capacity."""
    k = -(-int(sizes.sum()) // capacity)
    while True:
        out = difference(sizes, k) if k else []
        if all(int(sizes[w].sum()) <= capacity for w in out):
            return [w for w in out if w]
        k += 1


def cuts(n: int, capacity: int, piece: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of a document's full sequences, and of the pieces of its rest."""
    full = n // capacity * capacity
    rest = n - full
    m = -(-rest // piece) if rest else 0
    edge = [full + rest * k // m for k in range(m + 1)] if m else []
    return [(s, capacity) for s in range(0, full, capacity)], [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def tokenizer(path: str):
    """ids of a text as the file's library gives them without adding special tokens. Long texts are cut where no token can reach across; a text with the string of an added token goes to that library whole."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    whole = lambda s: t.encode(s, add_special_tokens=False).ids
    spec = json.loads(t.to_str())
    added = [x["content"] for x in spec.get("added_tokens", [])]
    ranks_of = _ranks(spec["model"])
    if ranks_of is None:
        return lambda s: np.array(whole(s), np.uint32)

    def ids(s: str) -> np.ndarray:
        if any(x in s for x in added):
            return np.array(whole(s), np.uint32)
        if len(s) <= _LONG:
            return np.array(ranks_of.encode_ordinary(s), np.uint32)
        cut, at = [0], _LONG
        while m := _SYNC.search(s, at):
            cut.append(m.start())
            at = m.start() + _LONG
        return np.concatenate([np.array(ranks_of.encode_ordinary(s[a:z]), np.uint32) for a, z in zip(cut, [*cut[1:], len(s)], strict=True)])

    return ids


def _ranks(model: dict):
    """The same vocabulary for the faster library, if its ids rise in the order of the merges, as byte-level BPE has it; else None."""
    import public_tokenizers
    import tiktoken

    if model.get("type") != "BPE" or model.get("byte_fallback") or model.get("end_of_word_suffix"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; the others follow from code point 256
    char = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = {s: i for s, i in model["vocab"].items() if all(c in char for c in s)}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or len(merged) + 256 > len(vocab):
        return None
    keep = {*merged, *(i for s, i in vocab.items() if len(s) == 1)}
    return tiktoken.Encoding("vocab", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes(char[c] for c in s): i for s, i in vocab.items() if i in keep}, special_tokens={})


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 1, piece: int = 512, run_docs: int = RUN_DOCS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    docs: doc_id, text. A document's ids are those of its whole text, strings of special tokens included, and then `end`; a null or empty text has `end` alone. Each id lies in exactly one piece; the pieces of a
    sequence follow one another from offset 0 and make up `capacity` at most. padded_length is the sequence's length where that is a power of two, else capacity. Rows with equal ids or
    texts are packed each for itself; an empty table gives no pieces. Documents are packed in runs as a task reads them, without any exchange; sequence_id holds the task's number and a
    count, and the same input splits give the same rows when a task is run again.
    """

    def flush(run: list[tuple], seq: int) -> tuple[pa.RecordBatch, int]:
        rows, sizes, items = [], [], []
        for d, (i, ids) in enumerate(run):
            full, rest = cuts(len(ids), capacity, piece)
            for s, n in full:
                rows.append((i, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids), seq, 0, capacity))
                seq += 1
            items += [(d, s) for s, _ in rest]
            sizes += [n for _, n in rest]
        sizes = np.array(sizes, np.int64)
        for w in windows(sizes, capacity):
            total, at = int(sizes[w].sum()), 0
            for k in w:
                (d, s), n = items[k], int(sizes[k])
                i, ids = run[d]
                rows.append((i, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids), seq, at, total if total & (total - 1) == 0 else capacity))
                at += n
            seq += 1
        kinds = _SCHEMA.replace(" long", "").split(", ")
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], kinds), seq

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, run, seq = tokenizer(path), [], TaskContext.get().partitionId() << 40
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                run.append((i, np.append(encode(t or ""), end).astype("<u4")))
                if len(run) == run_docs:
                    out, seq = flush(run, seq)
                    run = []
                    yield out
        if run:
            yield flush(run, seq)[0]

    return docs.select("doc_id", "text").mapInArrow(f, _SCHEMA)
