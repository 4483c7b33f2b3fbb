import hashlib
import random

import numpy as np
import pyarrow as pa

from quire.llm import blocks as B
from quire.llm import hashing as H
from quire.llm.phrases import dedup_phrases
from quire.llm.suffixes import dedup_suffixes


def ordered(docs):
    return sorted(docs.select("doc_id", "text").collect(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


def brute_phrases(rows, size):
    seen, out = set(), []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.add(key)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def brute_suffixes(rows, size):
    seen, out = {}, []
    for i, text in rows:
        t = (text or "").encode()
        for k in range(len(t) - size + 1):
            seen.setdefault(t[k : k + size], i)
    for i, text in rows:
        t = (text or "").encode()
        gone = [False] * len(t)
        for k in range(len(t) - size + 1):
            first = seen[t[k : k + size]]
            if first != i:
                gone[k : k + size] = [True] * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def norm(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1:])))


def test_phrases_brute(docs):
    for size, block in ((20, 2000), (3, 700), (20, 1 << 22)):
        got = dedup_phrases(docs, size, block).collect()
        assert norm(got) == norm(brute_phrases(ordered(docs), size)), (size, block)


def test_phrases_carry(docs):
    got = dedup_phrases(docs, 20, 2000, ("lang", "source", "block0")[:2]).collect()
    assert len(got) == docs.count() and set(got[0].asDict()) == {"doc_id", "n_words", "n_removed", "kept", "lang", "source"}


def test_automata_decide():
    """A block cuts what the phrases that it is sent cover and nothing else: without one of them its repeats stay."""
    import pyarrow as pa

    from quire.llm.phrases import _Block

    w = [f"w{k}" for k in range(200)]
    text = lambda *spans: " ".join(x for a, z in spans for x in w[a:z])
    b = _Block(pa.table({"doc_id": pa.array([1, 2, 3]), "text": [text((0, 60)), text((100, 130), (10, 50), (150, 180)), "  \n" + text((10, 50)).replace(" ", "\t")]}), 20)
    one, two = (text((10, 40)).encode(), False), (text((30, 50)).encode(), False)
    count = lambda phrases: np.add.reduceat(b.located(phrases), b.first[:-1]).tolist()
    assert count([one, two]) == [40, 40, 40] and count([one]) == [30, 30, 30] and count([two]) == [20, 20, 20] and count([]) == [0, 0, 0]
    assert count([(text((10, 50)).encode(), True)]) == [0, 40, 40]  # the first occurrence stays
    assert count([(text((10, 50)).encode()[:-1], False)]) == [0, 0, 0]  # no hit ends within a word


def test_shards(monkeypatch):
    """Phrases spread over many automata are located as by one."""
    import pyarrow as pa

    from quire.llm import phrases as F

    r = random.Random(4)
    t = pa.table({"doc_id": pa.array(range(30)), "text": [" ".join(r.choice("abcd") for _ in range(r.randint(0, 60))) for _ in range(30)]})
    b = F._Block(t, 3)
    some = [(" ".join(r.choice("abcd") for _ in range(r.randint(3, 6))).encode(), r.random() < 0.5) for _ in range(60)]
    want = b.located(some)
    monkeypatch.setattr(F, "SHARD_PHRASES", 7)
    assert (b.located(some) == want).all() and want.any()


def test_radix_groups():
    """Groups of equal strings, told apart by digits alone where all share a bucket."""
    from quire.llm.radix import equal_groups

    r = random.Random(3)
    for same in (True, False):
        words = [bytes(r.choice(b"ab") for _ in range(8)) + bytes(r.choice(b"xyz") for _ in range(8)) for _ in range(3000)]
        at = [np.array([int.from_bytes(x[k : k + 8], "big") for x in words], np.uint64) for k in (0, 8)]
        bucket = np.zeros(len(words), np.uint64) if same else at[0] * np.uint64(31)
        members, group = equal_groups(bucket, lambda k, of: at[k][of], 2)
        got = [[words[m] for m in members[group == g]] for g in np.unique(group)]
        assert all(len(set(x)) == 1 and len(x) > 1 for x in got)
        n = {x: words.count(x) for x in set(words)}
        assert {x[0]: len(x) for x in got} == {x: k for x, k in n.items() if k > 1}
        assert not same or [x[0] for x in got] == sorted(x[0] for x in got)


def test_clustered_ids(spark):
    """Blocks stay near their size where ids cluster and long texts stand together."""
    rows = [(k, "x" * 3000) for k in range(300)] + [(10**15 + k, "y" * (90000 if k < 20 else 100)) for k in range(400)] + [(None, "z"), (-(10**17), "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts, all_ = B.blocked(df, 1 << 17)
    got = {}
    for row in texts.collect():
        t = B._got(pa.table({"rows": pa.array([bytes(row.rows)], pa.binary())}))
        got.setdefault(row.block, []).extend(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    assert sorted((r for b in got.values() for r in b), key=str) == sorted(rows, key=str)
    assert max(sum(len(t) for _, t in b) for b in got.values()) < 4 << 17 and len(got) > all_["blocks"] // 3
    edge = [[i for i, _ in got[b] if i is not None] for b in sorted(got)]
    assert all(max(x) < min(y) for x, y in zip([e for e in edge if e], [e for e in edge if e][1:]))


def test_suffixes_brute(docs):
    for size, block in ((50, 2000), (20, 900), (50, 1 << 22)):
        got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in dedup_suffixes(docs, size, block).collect()]
        assert norm(got) == norm(brute_suffixes(ordered(docs), size)), (size, block)


def test_short_texts(spark):
    for n in (1, 30, 45, 49, 50, 60):
        df = spark.createDataFrame([(1, "x" * n), (2, "x" * n)], "doc_id long, text string").coalesce(1)
        got = sorted((r[0], r[2]) for r in dedup_suffixes(df).collect())
        assert got == [(1, 0), (2, n if n >= 50 else 0)]


def test_empty(empty):
    assert dedup_phrases(empty).collect() == [] and dedup_suffixes(empty).collect() == []


def test_reuses_the_texts_exchange(docs):
    for f in (dedup_phrases, dedup_suffixes):
        df = f(docs, block_bytes=2000)
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan


def test_hashing():
    r = random.Random(1)
    t = [" ".join(r.choice(["a", "bb", "ccc", "é"]) for _ in range(r.randint(0, 30))) for _ in range(50)]
    import pyarrow as pa

    data, off = H.buffers(pa.array(t + [None, ""]))
    s, e, first = H.words(data, off)
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(s, e)] == [w for x in t for w in x.encode().split()]
    assert np.diff(first).tolist() == [len(x.encode().split()) for x in t] + [0, 0]
    h = H.word_hashes(data, s, e)
    assert len(set(h.tolist())) == len({raw[a:b] for a, b in zip(s, e)})
    for n in (1, 2, 3, 5, 20):
        w = H.runs_of(h, n)
        keys = [tuple(raw[s[k] : e[k]] for k in range(i, i + n)) for i in range(len(h) - n + 1)]
        assert len(w) == len(keys) and len(set(w.tolist())) == len(set(keys)) == len(set(zip(w.tolist(), keys)))
    for n in (16, 17, 50, 64):
        w, short = H.byte_windows(data, n, 16)
        assert (short[: len(w)] == H.byte_windows(data, 16)[0][: len(w)]).all()
        keys = [raw[i : i + n] for i in range(len(raw) - n + 1)]
        assert len(w) == len(keys) and len(set(w.tolist())) == len(set(keys)) == len(set(zip(w.tolist(), keys)))
    x = np.array([r.getrandbits(60) for _ in range(300)], np.uint64)
    assert H.sliding_min(x, 35).tolist() == [min(x[i : i + 35].tolist()) for i in range(len(x) - 34)]


def test_pack():
    r = random.Random(2)
    for n, bits in ((0, 64), (1, 64), (5, 64), (1000, 40), (100000, 20)):
        k = np.unique(np.array([r.getrandbits(bits) for _ in range(n)], np.uint64))
        assert (B.unpack(B.pack(k)) == k).all()
        cut = B.split(k, bits, 7)
        assert cut[0] == 0 and cut[-1] == len(k) and (np.diff(cut) >= 0).all()
    assert hashlib.sha256(B.pack(np.array([3, 5, 260], np.uint64))).hexdigest()
