"""Substring dedup by repeated-phrase automata (operator 7).

* Candidates: each window of `size` words belongs to the least hash among the word groups in it, and neighbours share it; windows whose least group stands nowhere else are dropped.
* Confirmed: runs of neighbouring candidates go as text to the part that owns their least group, equal ones once for each block; there windows are compared byte by byte, and the part sends to
  each block the text of the phrases (runs of repeated windows) that it holds, marked by whether an earlier block holds them too. No positions travel.
* Located: a block compiles Aho-Corasick automata of its phrases, a shard of SHARD_PHRASES at a time, and streams all of its documents through each. An automaton holds the first words of each phrase;
  where it hits, the whole phrase is compared with the text. What these hits cover is cut, but for the first hit of a window that no earlier block has.

Hashes only choose what is compared and where; they miss no repeat and decide none. A block without a phrase's text can't cut it.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import hashing as H
from .radix import equal_groups

#: Phrases of one automaton; words of each that it holds; words of the groups that choose parts.
SHARD_PHRASES, HEAD, GROUP = 1 << 15, 8, 5


class _Block:
    """The documents of a block: words joined by single spaces, documents by a line feed (no word can hold one)."""

    def __init__(self, t: pa.Table, size: int):
        self.t, self.size = B.in_order(t), size
        self.data, self.off = H.buffers(self.t["text"])
        self.starts, self.ends, self.first = H.words(self.data, self.off)
        raw = self.data.tobytes()
        self.pieces = [b" ".join(raw[a:b].split()) for a, b in zip(self.off[:-1].tolist(), self.off[1:].tolist(), strict=True)]
        self.length = self.ends - self.starts
        words = np.diff(self.first)
        gaps = np.where(words > 0, 2, 3)
        self.begin = 1 + np.cumsum(self.length + 1) - (self.length + 1) + np.repeat(np.cumsum(gaps) - gaps, words)

    def text(self) -> bytes:
        return b" " + b" \n ".join(self.pieces) + b" "

    def runs(self, bits: int) -> np.ndarray:
        """Runs of windows (first word, number, least group's hash, row); the distinct hashes. A window that begins with the least group is the last that holds it there."""
        width = min(GROUP, self.size)
        groups = H.runs_of(H.word_hashes(self.data, self.starts, self.ends), width)
        low = H.sliding_min(groups, self.size - width + 1)
        row = np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))
        at = np.flatnonzero(np.arange(len(low)) + self.size <= self.first[1:][row[: len(low)]])
        v = low[at]
        new = np.ones(len(at), bool)
        new[1:] = (v[1:] != v[:-1]) | (at[1:] != at[:-1] + 1) | (groups[at[:-1]] == v[:-1])
        heads = np.flatnonzero(new)
        self.start, self.count, self.least = at[heads], np.diff(np.append(heads, len(at))), H.mix(v[heads]) >> H.U64(64 - bits)  # mixed anew: least hashes are small
        keys, self.which, n = np.unique(self.least, return_inverse=True, return_counts=True)
        self.several = n > 1
        return keys

    def fragments(self, replies: pa.Table, bits: int, parts: int) -> list[tuple[int, bytes]]:
        """For each part the distinct texts of runs that may recur, and whether each stands here several times."""
        keys = self.runs(bits)
        open_ = np.flatnonzero((B.told(replies, 1, keys, bits, parts)[0] | self.several)[self.which]) if len(keys) else np.zeros(0, np.int64)
        text, last = self.text(), self.start[open_] + self.count[open_] + self.size - 2
        a, z = self.begin[self.start[open_]], self.begin[last] + self.length[last] if len(open_) else open_
        part = B.part_of(self.least[open_], bits, parts)
        found: list[dict[bytes, int]] = [{} for _ in range(parts)]
        for p, x, y in zip(part.tolist(), a.tolist(), z.tolist(), strict=True):
            s, d = text[x:y], found[p]
            d[s] = d.get(s, 0) + 1
        return [(p, B.zipped(bytes(n > 1 for n in d.values()) + b"\n" + b"\n".join(d))) for p, d in enumerate(found) if d]

    def located(self, phrases: list[tuple[bytes, bool]]) -> np.ndarray:
        """Which words the phrases cover where automata find them; (text, here first): of a window of a phrase here first the first hit doesn't count."""
        cover = np.zeros(len(self.starts) + 1, np.int64)
        whole = self.text().decode("latin-1")
        firsts: dict[str, int] = {}
        own: dict[int, str] = {}
        for k in range(0, len(phrases), SHARD_PHRASES):
            heads: dict[str, list] = {}
            for x, here in phrases[k : k + SHARD_PHRASES]:
                s = x.decode("latin-1") + " "
                w = s.split(" ", HEAD)
                head = " " + " ".join(w[:-1]) + " " if len(w) > HEAD else " " + s
                heads.setdefault(head, []).append((s, s.count(" "), here))
            automaton = ahocorasick.Automaton()
            for head, of in heads.items():
                automaton.add_word(head, (len(head) - 2, of))
            automaton.make_automaton()
            hits, spans = [], []
            for end, (back, of) in automaton.iter(whole):
                at = end - back
                for s, n, here in of:
                    if whole.startswith(s, at):
                        hits.append(at)
                        spans.append(-n if here else n)
            first = np.searchsorted(self.begin, np.array(hits, np.int64))
            n = np.array(spans, np.int64)
            later = n > 0
            np.add.at(cover, first[later], 1)
            np.add.at(cover, first[later] + n[later], -1)
            for w, m in zip(first[~later].tolist(), (-n[~later]).tolist(), strict=True):
                for i in range(w, w + m - self.size + 1):
                    if i not in own:
                        s = own[i] = whole[self.begin[i] : self.begin[i + self.size - 1] + self.length[i + self.size - 1]]
                        firsts[s] = min(i, firsts.get(s, i))
        again = np.array([i for i, s in own.items() if firsts[s] != i], np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + self.size, -1)
        return np.cumsum(cover)[:-1] > 0


def dedup_phrases(docs: DataFrame, size: int = 20, block_bytes: int = B.BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, carried columns): each word covered by a `size`-word window that starts earlier too is cut.

    docs: doc_id, text and the columns to carry. Words are maximal runs of bytes other than 32 and 9 to 13; earlier means in a
    document of smaller doc_id, or earlier in the same one. kept has the other words, joined by single spaces.
    A null text has no words and an empty kept; a null doc_id counts as the least; rows that share a doc_id are parts of one document in order
    of their texts, and no window crosses rows. An empty table gives an empty table. Texts may have any length; one row is held in memory.
    """
    texts, all_ = B.blocked(docs.select("doc_id", "text", *(c for c in carry if c not in ("doc_id", "text"))), block_bytes)
    bits, parts = B.bits_for(all_["bytes"]), all_["parts"]

    def first(block: int, t: pa.Table) -> pa.Table:
        return B.ask(block, 1, _Block(t, size).runs(bits), bits, parts)

    def second(block: int, t: pa.Table, replies: pa.Table) -> pa.Table:
        out = _Block(t, size).fragments(replies, bits, parts)
        return B.rows_for(block, 2, [p for p, _ in out], [x for _, x in out])

    def cut(block: int, t: pa.Table, phrases: pa.Table) -> pa.Table:
        b = _Block(t, size)
        gone = b.located([(s, here) for _, *kinds in B.rows_of(phrases, 2) for here, x in zip((False, True), kinds, strict=True) if x for s in B.unzipped(x).split(b"\n")])
        before = np.concatenate([[0], np.cumsum(gone)])[b.first]
        removed = np.diff(before)
        kept = list(b.pieces)
        for k in np.flatnonzero(removed).tolist():
            kept[k] = b" ".join([x for x, out in zip(kept[k].split(b" "), gone[b.first[k] : b.first[k + 1]].tolist(), strict=True) if not out])
        out = {"doc_id": b.t["doc_id"], "n_words": pa.array(np.diff(b.first), pa.int64()), "n_removed": pa.array(removed.astype(np.int64)), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table(out | {c: b.t[c] for c in carry})

    one = B.answers(B.first_ask(texts, first))
    phrases = B.answers(B.with_answers(texts, one, second), lambda t: confirmed(t, size))
    kinds = dict(docs.dtypes)
    return B.with_answers(texts, phrases, cut, ", ".join(["doc_id long, n_words long, n_removed long, kept string", *(f"`{c}` {kinds[c]}" for c in carry)]))


def confirmed(asked: pa.Table, size: int) -> pa.Table:
    """For each block the phrases of its fragments whose windows repeat, as text: those that an earlier block has too (asked), and those that stand several times in this one, the first to have them (more)."""
    asked = asked.sort_by("block")
    blobs, multi, owner = [], [], []
    for k, x in enumerate(asked["asked"]):
        raw = B.unzipped(x.as_buffer().to_pybytes())
        n = raw.index(b"\n")
        multi.append(np.frombuffer(raw, np.uint8, n) > 0)
        blobs.append(raw[n + 1 :])
        owner.append(np.full(n, k))
    multi, owner = np.concatenate(multi), np.concatenate(owner)
    raw = b"\n".join(blobs) + b"\n"
    del blobs
    data = np.frombuffer(raw, np.uint8)
    off = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    starts, ends, first = H.words(data, off)
    windows = np.diff(first) - (size - 1)
    begin = np.cumsum(windows) - windows
    fragment = np.repeat(np.arange(len(windows)), windows)
    word = np.repeat(first[:-1], windows) + np.arange(len(fragment)) - begin[fragment]
    at, length = starts[word], ends[word + size - 1] - starts[word]
    padded = np.append(data, np.zeros(8, np.uint8))

    def digit(k: int, of: np.ndarray) -> np.ndarray:
        left = length[of] - 8 * k
        d = H.eight_at(padded, np.where(left > 0, at[of] + 8 * k, 0))
        return np.where(left >= 8, d, d & ~(H.U64(0xFFFFFFFFFFFFFFFF) >> (8 * left.clip(0, 7)).astype(H.U64)))

    bucket = H.runs_of(H.word_hashes(data, starts, ends), size)[word] + length.astype(H.U64)
    members, group = equal_groups(bucket, digit, -(-int(length.max(initial=0)) // 8))
    state = multi[fragment].astype(np.int8) * 2  # 1: an earlier block has the window; 2: only this one and later ones, and here several times
    if len(members):
        mine = owner[fragment[members]]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(mine, heads)[group]
        here = np.bincount(group[mine == least], minlength=len(heads))[group] > 1
        state[members[(mine == least) & here]] = 2
        state[members[mine > least]] = 1
    new = np.ones(len(state), bool)
    new[1:] = (state[1:] != state[:-1]) | (fragment[1:] != fragment[:-1])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(state)) - 1
    keep = state[a] > 0
    a, z = a[keep], z[keep]
    out: list[tuple[dict, dict]] = [({}, {}) for _ in range(asked.num_rows)]
    for k, s, x, y in zip(owner[fragment[a]].tolist(), state[a].tolist(), at[a].tolist(), ends[word[z] + size - 1].tolist(), strict=True):
        out[k][s - 1][raw[x:y]] = None
    packed = [[B.zipped(b"\n".join(d)) if d else b"" for d in o] for o in out]
    return asked.set_column(3, "asked", pa.array([x for x, _ in packed], pa.binary())).set_column(4, "more", pa.array([y for _, y in packed], pa.binary()))
