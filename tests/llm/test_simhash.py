import random
from collections import defaultdict

import numpy as np
import xxhash

from quire.llm.components import components
from quire.llm.simhash import Tree, fingerprint, gray_rank, links, near_dups


def brute_fp(t, width=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    s = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(nodes, link):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if link(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    r = random.Random(3)
    for n in (0, 1, 2, 3, 4, 30, 300):
        t = " ".join(r.choice(["A", "bÉ", "Cc", "d."]) for _ in range(n)) + "\n"
        assert fingerprint(t.encode()) == brute_fp(t)


def test_gray():
    x = np.arange(64, dtype=np.uint64)
    code = x ^ (x >> np.uint64(1))
    assert gray_rank(code).tolist() == x.tolist()


def neighbours(r, n, spread, groups=8):
    base = [r.getrandbits(64) for _ in range(groups)]
    fps = {b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, spread))) & ((1 << 64) - 1) for b in base for _ in range(n // groups)}
    x = np.array(sorted(fps), np.uint64)
    return x[np.argsort(gray_rank(x))]


near2 = lambda x: lambda i, j: bin(int(x[i]) ^ int(x[j])).count("1") <= 2


def test_tree():
    """Groups of every size from one on, dense and sparse; several groups in one tree stay apart."""
    r = random.Random(6)
    for n, spread in ((8, 1), (16, 2), (17, 3), (70, 3), (300, 4), (700, 12), (900, 2)):
        x = neighbours(r, n, spread)
        want = brute_components(range(len(x)), near2(x))
        got = Tree(x[:, None], 2).labels()
        assert got.tolist() == [want[i] for i in range(len(x))]
    parts = [neighbours(r, 8 * r.randint(1, 30), 2, 4) for _ in range(40)]
    x, heads = np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]
    got = Tree(x[:, None], 2, heads).labels()
    want = [h + brute_components(range(len(p)), near2(p))[i] for h, p in zip(heads, parts) for i in range(len(p))]
    assert got.tolist() == want and Tree(x[:0, None], 2).labels().tolist() == []


def test_nodes_hold_bits_once():
    x = neighbours(random.Random(1), 700, 12)
    t = Tree(x[:, None], 2)
    held = np.zeros((len(x), 1), np.uint64)
    for first, _, pattern, mask in reversed(t.levels):
        mine = np.repeat(mask, np.diff(first), axis=0)
        assert not (mine & held).any()  # a bit lies in one node of each path
        assert not ((x[:, None] ^ np.repeat(pattern, np.diff(first), axis=0)) & mine).any()  # and all members agree on it
        held |= mine
    assert len(t.levels) > 2


def test_links_of_buckets(spark):
    """Buckets of a few fingerprints, some of which are hot and dealt again."""
    x = neighbours(random.Random(8), 1200, 3, 3)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").repartition(3)
    want = brute_components(range(len(x)), near2(x))
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    for bucket in (4, 64, 1 << 14):
        pairs = {(at[a], at[b]) for a, b in links(df, len(x), 2, bucket).collect()}
        assert brute_components(range(len(x)), lambda i, j: (i, j) in pairs or (j, i) in pairs) == want


def test_near_dups(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    r = random.Random(7)
    more = [(5000 + k, " ".join(r.choice("ab") for _ in range(r.randint(3, 9)))) for k in range(120)] + [(None, "only null here"), (None, "only null here")]
    rows = [tuple(x) for x in rows] + more
    fp = [brute_fp(t) for _, t in rows]
    roots = brute_components(set(fp), lambda a, b: bin(a ^ b).count("1") <= 2)
    least = defaultdict(list)
    for (i, _), f in zip(rows, fp):
        if i is not None:
            least[roots[f]].append(i)
    want = [(i, f - (1 << 64) if f >> 63 else f, min(least[roots[f]], default=None)) for (i, _), f in zip(rows, fp)]
    got = near_dups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    key = lambda x: tuple((z is not None, z or 0) for z in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert near_dups(empty).collect() == []


def test_components(spark):
    r = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(300)] + [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(250)] + [(5, 5), (None, 3), (-9, -8)]
    pairs = {(a, b) for a, b in links if a is not None and a != b}
    nodes = {x for p in pairs for x in p}
    want = {k: v for k, v in brute_components(sorted(nodes), lambda a, b: (a, b) in pairs or (b, a) in pairs).items() if k != v}
    assert dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect())) == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
