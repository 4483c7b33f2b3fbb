import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.bpe import Codec, encode, library
from quire.llm.packing import cuts, difference, pack, tokenizer, windows

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("leaf", [7, 64, 4096])
def test_tree_equals_library(leaf):
    codec, lib = Codec(PATH, P.PATTERN, leaf), library(PATH, P.PATTERN)
    r = random.Random(leaf)
    texts = ["", " ", "  ", "a", "a  b", "don't we'll 'S 'll", "x" * 500, " " * 300, "\n\n \n a\t b", "é😀" * 90, "a\x85 b\xa0 c  d 　e", "12345 678" * 30, "<|endoftext|> x", "日本語" * 60]
    alphabet = ["a", "B", " ", "  ", "\n", "'s", "é", "1", "!", "\xa0", "😀", "word", " the", "\t"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 300))) for _ in range(150)]
    for t in texts:
        ids = codec.encode(t)
        assert ids.tolist() == lib.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_tree_any_text(t):
    codec = _codec()
    assert codec.encode(t).tolist() == library(PATH, P.PATTERN).encode_ordinary(t)


def _codec(kept=[]):
    return kept[0] if kept else kept.append(Codec(PATH, P.PATTERN, 5)) or kept[0]


def test_encode(docs, empty):
    lib = library(PATH, P.PATTERN)
    got = encode(docs, PATH, P.PATTERN).collect()
    want = [(i, np.array(lib.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in docs.select("doc_id", "text").collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(r[0], bytes(r[2]), bytes(r[3])) for r in got], key=key) == sorted(want, key=key)
    assert all(r[1] * 4 == len(r[2]) for r in got)
    assert encode(empty, PATH, P.PATTERN).collect() == []


def brute_difference(sizes, k):
    """Multiway differencing with full lists of k windows, item by item."""
    parts = [(s, -i, [(s, [i])] + [(0, [])] * (k - 1)) for i, s in enumerate(sizes)]
    turn = len(sizes)
    key = lambda p: (p[2][0][0] - p[2][-1][0], p[1])
    while len(parts) > 1:
        parts.sort(key=key)
        a, b = parts.pop()[2], parts.pop()[2]
        both = sorted(((x + y, sorted(p + q)) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda w: -w[0])
        parts.append((0, -turn, both))
        turn += 1
    return parts[0][2] if parts else []


def test_difference():
    r = random.Random(3)
    for _ in range(150):
        sizes, k = [r.randint(1, 60) for _ in range(r.randint(1, 60))], r.randint(1, 12)
        got = difference(np.array(sizes), k)
        assert len(got) == k and sorted(i for w in got for i in w) == list(range(len(sizes)))
        sums = sorted(sum(sizes[i] for i in w) for w in got)
        assert sums == sorted(s for s, _ in brute_difference(sizes, k))
    sums = [sum(int(x) for x in np.arange(1, 201)[w]) for w in difference(np.arange(1, 201), 7)]
    assert max(sums) - min(sums) <= 7


def test_windows():
    """No item is cut; the number of windows is the first one from the least on whose differencing fits."""
    r, rose = random.Random(4), 0
    for _ in range(150):
        cap = r.randint(20, 60)
        sizes = np.array([r.randint(1, cap) for _ in range(r.randint(1, 60))])
        got = windows(sizes, cap)
        assert sorted(i for w in got for i in w) == list(range(len(sizes))) and all(sizes[w].sum() <= cap for w in got)
        k = -(-int(sizes.sum()) // cap)
        while max(s for s, _ in brute_difference(sizes.tolist(), k)) > cap:
            k += 1
            rose += 1
        assert len(got) == k
    assert rose > 20 and windows(np.zeros(0, np.int64), 9) == []
    assert cuts(2048, 2048, 256) == ([(0, 2048)], []) and cuts(2049, 2048, 256)[1] == [(2048, 1)] and cuts(600, 2048, 256)[1] == [(0, 200), (200, 200), (400, 200)]


def test_ids_are_the_library_s():
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokenizer(P.path("byte_bpe_50k.json"))
    r = random.Random(5)
    texts = ["", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext|", "don't we'll", "  a  b\n\n c ", "é😀 日本語 \xa0x", "word " * 40000 + "  end", "x" * 70000 + " y " * 9, "\n " * 300]
    texts += ["".join(r.choice(["a", " the", "  ", "\n", "é", "1", "!", "'s", "<|endoftext|>"]) for _ in range(r.randint(0, 200))) for _ in range(100)]
    for s in texts:
        assert ids(s).tolist() == t.encode(s, add_special_tokens=False).ids, s[:50]


def test_pack(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in rows.collect()}
    got = pack(rows, P.path("byte_bpe_50k.json")).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for x, of in ((by_doc, ids), (by_seq, None)):
        for k, v in x.items():
            at = 0
            for s, n in sorted(v):
                assert s == at and n > 0
                at += n
            assert at == len(of[k]) if of else at <= 2048
    assert set(by_doc) == set(ids)
    assert pack(empty, P.path("byte_bpe_50k.json")).collect() == []
    every = [(r.doc_id, r.length) for r in pack(docs, P.path("byte_bpe_50k.json")).collect()]  # repeated and null ids: each row's ids are there
    total = lambda i: sum(n for d, n in every if d == i)
    want = defaultdict(int)
    for i, x in docs.select("doc_id", "text").collect():
        want[i] += len(t.encode(x or "", add_special_tokens=False).ids) + 1
    assert None in want and {i: total(i) for i in want} == want


def test_padding():
    r = random.Random(9)
    sizes = np.array([r.randint(1, 256) for _ in range(3000)])
    w = windows(sizes, 2048)
    assert len(w) * 2048 < sizes.sum() + 2048
    assert hashlib.sha256(str(w).encode()).hexdigest() == hashlib.sha256(str(windows(sizes, 2048)).encode()).hexdigest()
