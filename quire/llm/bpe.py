"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 4).

A text is halved down to leaves; a leaf's ids come from the library. Two neighbours are joined by encoding anew a window around their boundary that grows,
half by half, until it begins and ends at sync points: a space after a character that is no white space. No match of the pattern holds
such a pair of characters, and where a match begins depends only on the text from there on, so the tokens before the left sync point and from the right one on
can't change. Where a side has no sync point, all of it is in the window. Decoding joins the leaves' bytes up the same tree.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAF_CHARS, WORDS_KEPT = 4096, 600_000
#: A space that may not be a sync point: at the start, or after white space.
_ODD = re.compile(r"\A |\s ")
_BEFORE = [c + " " for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"]
_SYNC = re.compile(r"(?<=\S)(?= )")


@functools.lru_cache(4)
def library(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _odd(text: str) -> bool:
    """Does some space stand at the start or after white space?"""
    if text[0] == " " or any(p in text for p in _BEFORE):
        return True
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return _ODD.search(text) is not None


class _Numbers(dict):
    """Numbers of pieces; a new one is encoded when it is first asked for."""

    def __init__(self, add, lead: str):
        self.add, self.lead = add, lead

    def __missing__(self, piece: str) -> int:
        k = self[piece] = self.add(self.lead + piece)
        return k


class Words:
    """Ids of text cut at sync points, remembered by piece; memory is bounded by starting anew."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.plain, self.spaced = _Numbers(self._add, ""), _Numbers(self._add, " ")  # the second's pieces stand without the space that begins them
        self.flat, self.at, self.size = array("I"), array("q"), array("q")

    def _add(self, piece: str) -> int:
        ids = self.encode(piece)
        self.at.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return len(self.at) - 1

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if len(self.at) > WORDS_KEPT or len(self.flat) > 16 * WORDS_KEPT:
            self.clear()
        if _odd(text):
            k = list(map(self.plain.__getitem__, _SYNC.split(text)))
        else:
            first, *rest = text.split(" ")
            k = [self.plain[first], *map(self.spaced.__getitem__, rest)]
        k = np.array(k)
        n = np.frombuffer(self.size, np.int64)[k]
        ends = np.cumsum(n)
        return np.frombuffer(self.flat, np.uint32)[np.repeat(np.frombuffer(self.at, np.int64)[k] - ends + n, n) + np.arange(ends[-1])]


class Node:
    """An element of the monoid: a stretch of text and its ids as if it stood alone."""

    __slots__ = ("ids", "text")

    def __init__(self, text: str, ids: np.ndarray):
        self.text, self.ids = text, ids


class Codec:
    def __init__(self, path: str, pattern: str, leaf: int = LEAF_CHARS):
        self.library, self.leaf = library(path, pattern), leaf
        self.words = Words(self.library.encode_ordinary)
        n = self.library.n_vocab
        self.bytes_of = [b""] * n
        for i in range(n):
            try:
                self.bytes_of[i] = self.library.decode_single_token_bytes(i)
            except KeyError:
                pass
        self.length = np.array([len(b) for b in self.bytes_of])

    def encode(self, text: str) -> np.ndarray:
        return self._tree(text).ids

    def _tree(self, text: str) -> Node:
        if len(text) <= self.leaf:
            return Node(text, self.words(text))
        half = len(text) // 2
        return self.join(self._tree(text[:half]), self._tree(text[half:]))

    def join(self, left: Node, right: Node) -> Node:
        reach = 64
        while True:  # the window grows until both sides have a sync point or are used up
            a, b = max(0, len(left.text) - reach), min(len(right.text), reach)
            cut = self._last_sync(left.text, a) if a else 0
            end = self._first_sync(right.text, b) if b < len(right.text) else len(right.text)
            if cut is not None and end is not None:
                break
            reach *= 4
        keep = len(left.ids) - self._tokens(left.ids[::-1], len(left.text[cut:].encode()))
        skip = self._tokens(right.ids, len(right.text[:end].encode()))
        return Node(left.text + right.text, np.concatenate([left.ids[:keep], self.words(left.text[cut:] + right.text[:end]), right.ids[skip:]]))

    @staticmethod
    def _last_sync(text: str, a: int) -> int | None:
        p = len(text) - 1
        while (p := text.rfind(" ", max(1, a), p + 1)) > 0:
            if not text[p - 1].isspace():
                return p
            p -= 1
        return None

    @staticmethod
    def _first_sync(text: str, b: int) -> int | None:
        p = 1
        while (p := text.find(" ", p, b)) > 0:
            if not text[p - 1].isspace():
                return p
            p += 1
        return None

    def _tokens(self, ids: np.ndarray, n_bytes: int) -> int:
        """So many of the first ids make up these bytes."""
        if not n_bytes:
            return 0
        step = 256
        while True:
            ends = np.cumsum(self.length[ids[:step]])
            k = int(np.searchsorted(ends, n_bytes))
            if k < len(ends):
                assert ends[k] == n_bytes
                return k + 1
            step *= 8

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids (binary, little-endian unsigned 32-bit integers) of each whole text and the bytes that they decode to.

    docs: doc_id, text. A null text is empty and has no tokens; rows are independent, so equal ids and texts stay as they are, and an empty table
    gives an empty table. A text may have any length and any characters. path: a file of ranks that every executor has; no special tokens.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern, leaf)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                ids = [codec.encode(t or "") for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([codec.decode(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(f, "doc_id long, n_tokens long, ids binary, decoded binary")


