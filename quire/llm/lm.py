"""LM scoring by a weighted backoff automaton (operator 5).

Words, word pairs and triples are counted over all training documents by the exchange in blocks.py: a block sends its distinct hashes
with counts, and the part that owns a hash answers with the corpus count. Triples are counted where their first pair was seen LEAST times or more; others aren't part of the model.

From the answers a block compiles the part of the automaton that its documents can reach. States are the root, known words, and pairs seen LEAST times or more; an arc leads from a state by a word to the longest
known end of what was read, with the smoothed log-probability; a failure arc leads to the state without its first word, with the weight held back. Documents are traversed from left to right, many
at a time, each carrying its state: a word without an arc adds the weight of the failure arc and is tried again from there. Smoothing is by absolute discounting of words and pairs (discounts from the
numbers of those seen once and twice) and, for triples, interpolation that holds back HELD * n ** -FADE after a pair seen n times. All unseen words are one class, as in the base score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import hashing as H

HELD, FADE, LEAST = 0.85, 0.1, 2
#: Tokens that one lane of the traversal reads; a later stretch of a text is begun two tokens earlier, after which it is in the state that the text's own traversal is in.
STRETCH = 512
_END = H.U64(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _small(x: np.ndarray) -> bytes:
    """Counts in the narrowest of four widths, compressed."""
    top = int(x.max()) if len(x) else 0
    code = next(k for k, most in enumerate((1 << 8, 1 << 16, 1 << 32, 1 << 64)) if top < most)
    return B.zipped(bytes([code]) + x.astype((np.uint8, np.uint16, np.uint32, np.uint64)[code]).tobytes())


def _large(blob: bytes) -> np.ndarray:
    blob = B.unzipped(blob)
    return np.frombuffer(blob, (np.uint8, np.uint16, np.uint32, np.uint64)[blob[0]], offset=1).astype(np.int64)


def _totals(asked: pa.Table) -> pa.Table:
    """For each pass in a part: the corpus counts of each block's keys and whether the block is the first to have counted them; pass 1 (words) also has this part's totals of words and pairs."""
    asked = asked.sort_by("block")
    step = asked["pass"].to_numpy()
    out, totals = [], {}
    for p in np.unique(step).tolist():
        rows, totals[p] = _total(asked.filter(pa.array(step == p)))
        out.append(rows)
    head = b"".join(totals.get(p, np.zeros(4, np.int64)).tobytes() for p in (1, 2))
    return pa.concat_tables([t.set_column(4, "more", pa.array([head] * t.num_rows, pa.binary())) if t["pass"][0].as_py() == 1 else t for t in out])


def _total(asked: pa.Table) -> tuple[pa.Table, np.ndarray]:
    got = [B.unpack(x.as_buffer().to_pybytes()) for x in asked["asked"]]
    counts = [_large(x.as_buffer().to_pybytes()) for x in asked["more"]]
    at = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(int)
    keys, n = np.concatenate(got), np.concatenate(counts)
    del got, counts
    order = np.argsort(keys, kind="stable")
    s, c = keys[order], n[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    total = np.add.reduceat(c, np.flatnonzero(head)) if len(s) else c
    sums = np.empty(len(keys), np.int64)
    sums[order] = total[np.cumsum(head) - 1] if len(s) else 0
    first = np.zeros(len(keys), bool)
    counted = order[c > 0]
    if len(counted):
        first[counted[np.concatenate([[True], keys[counted][1:] != keys[counted][:-1]])]] = True
    stats = np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.int64)
    out = asked.set_column(3, "asked", pa.array([_small(sums[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary()))
    return out.set_column(4, "more", pa.array([np.packbits(first[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())), stats


def _asked(block: int, step: int, keys: np.ndarray, n: np.ndarray, bits: int, parts: int) -> pa.Table:
    """Rows that ask about sorted distinct keys with their counts here; about words, every part is asked, for its totals."""
    cut = B.split(keys, bits, parts)
    to = [p for p in range(parts) if cut[p + 1] > cut[p] or step == 1]
    return B.rows_for(block, step, to, [B.pack(keys[cut[p] : cut[p + 1]]) for p in to], [_small(n[cut[p] : cut[p + 1]]) for p in to])


def _counts(replies: pa.Table, step: int, keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    cut, sums = B.split(keys, bits, parts), np.zeros(len(keys), np.int64)
    for p, a, _ in B.rows_of(replies, step):
        sums[cut[p] : cut[p + 1]] = _large(a)
    return sums


def _first(replies: pa.Table, step: int, keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    cut, first = B.split(keys, bits, parts), np.zeros(len(keys), bool)
    for p, _, b in B.rows_of(replies, step):
        first[cut[p] : cut[p + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=int(cut[p + 1] - cut[p]))
    return first


def _distinct(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, the sum of its weights, and which of them each key is."""
    order = np.argsort(keys)
    s = keys[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    heads, which = np.flatnonzero(head), np.empty(len(keys), np.int64)
    which[order] = np.cumsum(head) - 1
    return s[heads], order[heads], np.add.reduceat(weights[order].astype(np.int64), heads) if len(heads) else heads, which


class _Block:
    """The tokens of a block's documents, and its distinct words, pairs and triples with their counts here."""

    def __init__(self, t: pa.Table, bits: int):
        self.t, self.bits = t, bits
        data, off = H.buffers(t["text"])
        data = _LOWER[data]
        starts, ends, first = H.words(data, off)
        rows = len(off) - 1
        self.begin, self.end = first[:-1] + np.arange(rows), first[1:] + np.arange(rows)
        self.token = np.empty(len(starts) + rows, H.U64)
        is_end = np.zeros(len(self.token), bool)
        is_end[self.end] = True
        self.token[~is_end] = H.word_hashes(data, starts, ends)
        self.token[self.end] = _END
        self.held = t["held_out"].to_numpy(zero_copy_only=False).astype(bool) if rows else np.zeros(0, bool)
        self.train = np.repeat(~self.held, np.diff(first) + 1)
        self.place = np.arange(len(self.token)) - np.repeat(self.begin, np.diff(first) + 1)
        shift = H.U64(64 - bits)
        self.word, _, self.counts, self.which = _distinct(self.token >> shift, self.train)
        self.second = np.flatnonzero(self.place >= 1)
        self.pair_hash = H.pair(self.token[self.second - 1], self.token[self.second])
        self.pair, one, self.pair_counts, pair_of = _distinct(self.pair_hash >> shift, self.train[self.second])
        self.before, self.after = self.which[self.second[one] - 1], self.which[self.second[one]]
        self.pair_of = np.full(len(self.token), -1)
        self.pair_of[self.second] = pair_of

    def triples(self, pairs: np.ndarray) -> None:
        """Distinct triples whose first pair's corpus count is LEAST or more: their counts here, their two pairs and last word."""
        hashes = np.zeros(len(self.token), H.U64)
        hashes[self.second] = self.pair_hash
        third = np.flatnonzero(self.place >= 2)
        third = third[pairs[self.pair_of[third - 1]] >= LEAST]
        keys = H.pair(hashes[third - 1], self.token[third], 1) >> H.U64(64 - self.bits)
        self.triple, one, self.triple_counts, _ = _distinct(keys, self.train[third])
        self.one, self.two, self.third = self.pair_of[third[one] - 1], self.pair_of[third[one]], self.which[third[one]]


class Automaton:
    """States 0 (the root), words and pairs; arcs sorted by state and word; failure arcs."""

    def __init__(self, source: np.ndarray, word: np.ndarray, log: np.ndarray, to: np.ndarray, fail_log: np.ndarray, fail_to: np.ndarray, root_log: np.ndarray, root_to: np.ndarray):
        key = source * len(root_log) + word
        order = np.argsort(key)
        self.key, self.log, self.to = np.append(key[order], -1), log[order], to[order]
        self.fail_log, self.fail_to, self.root_log, self.root_to = fail_log, fail_to, root_log, root_to

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-probability of each word in its state, and the state after it."""
        log, new = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left, s = np.arange(len(state)), state
        while len(left):
            w = word[left]
            root = s == 0
            if root.any():
                log[left[root]] += self.root_log[w[root]]
                new[left[root]] = self.root_to[w[root]]
                left, s, w = left[~root], s[~root], w[~root]
            key = s * len(self.root_log) + w
            arc = np.searchsorted(self.key[:-1], key)
            hit = self.key[arc] == key
            log[left[hit]] += self.log[arc[hit]]
            new[left[hit]] = self.to[arc[hit]]
            left, s = left[~hit], s[~hit]
            log[left] += self.fail_log[s]
            s = self.fail_to[s]
        return log, new

    def traverse(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The log-probability of each word of the texts that begin and end there."""
        many = -(-(end - begin) // STRETCH)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        a = np.repeat(begin, many) + nth * STRETCH
        z = np.minimum(a + STRETCH, np.repeat(end, many))
        early = np.where(nth > 0, 2, 0)
        order = np.argsort(-(z - a + early), kind="stable")
        a, z, early = a[order] - early[order], z[order], early[order]
        lengths, state, out = z - a, np.zeros(len(a), np.int64), np.zeros(len(words))
        for t in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-lengths, -t))
            log, state = self.step(state[:n], words[a[:n] + t])
            counts = early[:n] <= t
            out[a[:n][counts] + t] = log[counts]
        return out


def score_lm(docs: DataFrame, holdout: int = 10, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents, learnt from those not held out.

    docs: doc_id, text. Held out: crc32 of the id as text is divisible by `holdout` (a null id counts as 0). Tokens: A-Z lower-cased words of bytes other than
    32 and 9 to 13, then one end; a null or empty text is the end alone. Rows with equal ids or texts count and are scored each for itself.
    Without training tokens every token has probability 1. An empty table gives an empty table.
    """
    flagged = docs.select("doc_id", "text", (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % holdout == 0).alias("held_out"))
    texts, all_ = B.blocked(flagged, block_bytes)
    bits, parts = B.bits_for(all_["bytes"], 31), all_["parts"]

    def count(block: int, t: pa.Table) -> pa.Table:
        b = _Block(t, bits)
        return pa.concat_tables([_asked(block, 1, b.word, b.counts, bits, parts), _asked(block, 2, b.pair, b.pair_counts, bits, parts)])

    def more(block: int, t: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(t, bits)
        followers = np.bincount(b.before[_first(replies, 2, b.pair, bits, parts)], minlength=len(b.word))
        often = _counts(replies, 1, b.word, bits, parts) > 1  # a word seen once has one follower
        b.triples(_counts(replies, 2, b.pair, bits, parts))
        return pa.concat_tables([_asked(block, 3, b.triple, b.triple_counts, bits, parts), _asked(block, 4, b.word[often], followers[often], bits, parts)])

    def score(block: int, t: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(t, bits)
        totals = sum((np.frombuffer(x, np.int64) for _, _, x in B.rows_of(replies, 1)), np.zeros(8, np.int64))
        (n, v, n1, n2), (_, _, p1, p2) = totals[:4].tolist(), totals[4:].tolist()
        c, pairs = _counts(replies, 1, b.word, bits, parts), _counts(replies, 2, b.pair, bits, parts)
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        b.triples(pairs)
        triples, followers = _counts(replies, 3, b.triple, bits, parts), (c > 0).astype(np.int64)
        followers[c > 1] = _counts(replies, 4, b.word[c > 1], bits, parts)
        log = _automaton(b, c, pairs, triples, followers, n, v, _discount(n1, n2), _discount(p1, p2)).traverse(b.which, b.begin, b.end + 1)
        add = lambda x: np.add.reduceat(x, b.begin) if len(b.begin) else x[:0]
        return pa.table({
            "doc_id": b.t["doc_id"], "held_out": pa.array(b.held), "n_tokens": np.diff(np.append(b.begin, len(b.token))), "n_known": add((c > 0)[b.which].astype(np.int64)),
            "train_tokens": np.full(len(b.begin), n, np.int64), "base_score": add(base[b.which]), "score": add(log),
        })

    counted = B.answers(B.first_ask(texts, count), _totals)
    further = B.answers(B.with_answers(texts, counted, more), _totals)
    return B.with_answers(texts, counted.unionAll(further), score, _SCHEMA)


def _discount(once: int, twice: int) -> float:
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


def _automaton(b: _Block, c: np.ndarray, pairs: np.ndarray, triples: np.ndarray, followers: np.ndarray, n: int, v: int, d1: float, d2: float) -> Automaton:
    words = len(b.word)
    root = np.where(c > 0, c - d1, d1 * v) / n if n else np.ones(len(c))  # arcs of the root, and its one for all unseen words
    fail = d2 * followers / np.maximum(c, 1)
    by_pair = np.where(pairs > 0, (pairs - d2) / np.maximum(c[b.before], 1), 0) + fail[b.before] * root[b.after]
    held = HELD * np.maximum(pairs, 1).astype(float) ** -FADE
    two, three = np.flatnonzero(pairs > 0), np.flatnonzero(triples > 0)
    first = b.one[three]
    by_triple = (1 - held[first]) * triples[three] / pairs[first] + held[first] * by_pair[b.two[three]]
    fail_log = np.log10(np.concatenate([[1.0], np.where(followers > 0, fail, 1), held]))
    after = lambda k: np.where(pairs[k] >= LEAST, 1 + words + k, 1 + b.after[k])
    return Automaton(
        np.concatenate([1 + b.before[two], 1 + words + first]), np.concatenate([b.after[two], b.third[three]]), np.log10(np.concatenate([by_pair[two], by_triple])),
        np.concatenate([after(two), after(b.two[three])]), fail_log, np.concatenate([[0], np.zeros(words, np.int64), 1 + b.after]), np.log10(root), np.where(c > 0, 1 + np.arange(words), 0),
    )
