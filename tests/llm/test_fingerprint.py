import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quire.llm.fingerprint import edit_fingerprints, likeness, signature


def edits(rows):
    """(doc_id, n_chars, sha of the edited text, next text) of rows with distinct ids, a null id first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest(), t, n))
    return out


def test_edits(docs, spark, empty):
    rows = [tuple(r) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").collect()] + [(None, "a null id, one two three")]
    got = {r.doc_id: r for r in edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = edits(rows)
    assert len(got) == len(want)
    by_text = {}
    for i, n, sha, t, nxt in want:
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha), i
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and by_text.setdefault(t, r.fingerprint) == r.fingerprint
        if t == nxt:
            assert r.near_next == 1
    long = [got[i] for i, n, _, t, _ in want if len(set(t.split())) > 15]
    assert sum(r.near_edited for r in long) > 2 * sum(r.near_next for r in long)
    assert edit_fingerprints(empty).collect() == []
    (one,) = edit_fingerprints(spark.createDataFrame([(1, "x y z")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"x y z"[:4] + b"x").hexdigest() and one.near_next == 1


def test_repeated_ids(docs):
    assert edit_fingerprints(docs).count() == docs.count()


def test_native_only(docs):
    plan = edit_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_order_and_occurrence(spark):
    """Equal bags of words in another order, or repeated more often, differ; the signature is that of the method computed plainly."""
    r = random.Random(4)
    w = [f"w{k}" for k in range(300)]
    s = w[:]
    r.shuffle(s)
    near = " ".join(w[:280] + s[:20])
    df = spark.createDataFrame([(" ".join(w), " ".join(s), near, " ".join(w + w))], "a string, b string, c string, d string")
    for c in "abcd":
        df = signature(df, c, f"s{c}")
    row = df.select(*(likeness(F.col("sa"), F.col(f"s{c}")).alias(c) for c in "abcd")).first()
    assert row.a == 1 and row.b < 0.15 and 0.5 < row.c < 1 and row.d < 0.9
    plain = spark.createDataFrame([("p q p q p q x p q",)], "t string")
    got = signature(plain, "t", "s", k=1, bins=2).first()["s"]
    assert got == _plain(spark, "p q p q p q x p q".split(), 2)


def _plain(spark, words, bins):
    h = lambda *x: spark.range(1).select(F.xxhash64(*x).alias("h")).first()["h"]
    mask = ((1 << 35) - 1) << 28
    seen, entries = {}, []
    for pos, x in enumerate(words):
        a = h(F.lit(x)) & mask
        n = seen[x] = seen.get(x, -1) + 1
        entries.append(((a if not n else h(F.lit(a), F.lit(n)) & mask) >> 28, pos))
    out = []
    for b in range(bins):
        mine = sorted(e for e in entries if e[0] >> 34 == b)[:2]
        mine.sort(key=lambda e: e[1])
        if mine:
            out.append(b << 27 | h(*(F.lit(e[0]).cast("long") for e in mine)) & ((1 << 27) - 1))
    return out


@pytest.mark.parametrize("t", ["", None, "one", "a" * 100])
def test_short(spark, t):
    s = signature(spark.createDataFrame([(t,)], "t string"), "t", "s").first()["s"]
    assert (len(s) > 0) == bool(t) and len(s) <= 32


def plain_signature(text, k=2, bins=32):
    """The method step by step, with the hash of the SQL functions: XXH64 with seed 42, further arguments seeded by the hash before."""
    import re
    import struct

    import xxhash

    def h(*args):
        seed = 42
        for a in args:
            raw = a.encode() if isinstance(a, str) else a
            seed = xxhash.xxh64_intdigest(raw, seed)
        return seed

    long, small = lambda v: struct.pack("<q", v), lambda v: struct.pack("<i", v)
    words = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    mask = (1 << 35) - 1
    mers = [(h(*words[i : i + k]) >> 28 & mask, i) for i in range(max(1, len(words) - k + 1))] if words else []
    seen, numbered = {}, []
    for x, i in sorted(mers):
        n = seen[x] = seen.get(x, -1) + 1  # which occurrence in the text this is
        numbered.append((x, i) if not n else (h(long(x << 28), small(n)) >> 28 & mask, i))
    out, shift = {}, 35 - (bins.bit_length() - 1)
    for x, i in sorted(numbered):
        out.setdefault(x >> shift, []).append((i, x))
    sig = []
    for b, entries in sorted(out.items()):
        two = [x for _, x in sorted(entries[:2])]  # the two least, in the order of the text
        sig.append(b << 27 | h(*map(long, two)) & (1 << 27) - 1)
    return sig


def test_plain_at_the_registered_setting(spark, docs):
    """Signatures and likenesses of the query's setting, two words a k-mer and 32 bins, against the plain method."""
    r = random.Random(11)
    texts = [" ".join(r.choice(["a", "bb", "the", "Ünï", "x" * 40, "日本語日本語日本語日本語日本語日本語"]) for _ in range(r.randint(0, 120))) for _ in range(60)]
    rows = [(9000 + k, t) for k, t in enumerate(texts)] + [(x.doc_id, x.text) for x in docs.collect() if x.doc_id is not None]
    rows = list(dict(rows).items())
    got = {x.doc_id: x for x in edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    shown = lambda sig: "".join(f"{v:08X}" for v in sig)

    def like(a, b):
        bins = {v >> 27 for v in a} | {v >> 27 for v in b}
        return len(set(a) & set(b)) / len(bins) if bins else 1.0

    for (i, _, _, t, nxt) in edits(rows):
        m = len(t) // 4
        own, edited, after = plain_signature(t), plain_signature(t[: len(t) - m] + nxt[:m]), plain_signature(nxt)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (shown(own), shown(edited)), i
        assert (got[i].near_edited, got[i].near_next) == pytest.approx((like(own, edited), like(own, after)))
