import math
import zlib
from collections import Counter

import pytest

import numpy as np

from quire.llm.lm import FADE, HELD, LEAST, STRETCH, Automaton, score_lm


def brute(rows):
    toks = [(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + ["</end>"]) for i, t in rows]
    held = [(0 if i is None else zlib.crc32(str(i).encode())) % 10 == 0 for i, _ in toks]
    c, c2, c3 = Counter(), Counter(), Counter()
    for (_, w), h in zip(toks, held):
        if not h:
            c.update(w)
            c2.update(zip(w, w[1:]))
            c3.update(zip(w, w[1:], w[2:]))
    n, v = sum(c.values()), len(c)
    kinds = Counter(a for a, _ in c2)
    disc = lambda x: min(0.9, max(0.1, a / (a + 2 * b))) if (a := sum(k == 1 for k in x.values())) + (b := sum(k == 2 for k in x.values())) else 0.5
    d1, d2 = disc(c), disc(c2)
    p1 = lambda w: ((c[w] - d1) if c[w] else d1 * v) / n if n else 1.0
    def p2(u, x):
        return max(c2[u, x] - d2, 0) / c[u] + d2 * kinds[u] / c[u] * p1(x) if c[u] else p1(x)

    def p3(t, u, x):
        if c2[t, u] < LEAST:
            return p2(u, x)
        held = HELD * c2[t, u] ** -FADE
        return (1 - held) * c3[t, u, x] / c2[t, u] + held * p2(u, x)

    out = []
    for (i, w), h in zip(toks, held):
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        s = sum(math.log10(p1(x) if k == 0 else p2(w[k - 1], x) if k == 1 else p3(w[k - 2], w[k - 1], x)) for k, x in enumerate(w))
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, base, s))
    total = [sum(p(x) for x in [*c, "never seen"]) for p in [p1, *(lambda x, t=t, u=u: p3(t, u, x) for t, u in list(c2)[:40] if u != "</end>")]]
    return out, total


@pytest.mark.parametrize("block", [3000, 1 << 22])
def test_brute(docs, block):
    want, total = brute(docs.select("doc_id", "text").collect())
    assert total == pytest.approx([1] * len(total)) and len(total) > 20
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got = sorted((tuple(r) for r in score_lm(docs, block_bytes=block).collect()), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_held_out_beats_base(docs):
    rows = [r for r in score_lm(docs).collect() if r.held_out and r.n_tokens > 20]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_edges(spark, empty):
    assert score_lm(empty).collect() == []
    only = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score_lm(only).collect())
    assert rows == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_traversal_stretches():
    """A long text read in stretches has the log-probabilities of one that is read in one go."""
    r = np.random.RandomState(3)
    words = r.randint(0, 4, 3 * STRETCH + 7)
    # every pair is a state; triples 0 1 2 and 3 3 3 have arcs, all others fail
    pair = lambda a, b: 5 + 4 * a + b
    two = [(1 + a, b, -a - 0.5 * b, pair(a, b)) for a in range(4) for b in range(4) if (a, b) != (2, 2)]
    three = [(pair(0, 1), 2, -7.0, pair(1, 2)), (pair(3, 3), 3, -9.0, pair(3, 3))]
    s, w, log, to = (np.array(x) for x in zip(*two, *three))
    fail_to = np.concatenate([[0], [0] * 4, [1 + b for _ in range(4) for b in range(4)]])
    m = Automaton(s, w, log.astype(float), to, np.linspace(0, 2, 21), fail_to, np.arange(4) * -0.1, np.arange(4) + 1)
    state, want = np.zeros(1, np.int64), []
    for x in words.tolist():
        lp, state = m.step(state, np.array([x]))
        want.append(lp[0])
    got = m.traverse(np.concatenate([words[:5], words]), np.array([0, 5]), np.array([5, 5 + len(words)]))
    assert got[5:].tolist() == want and got[:5].tolist() == want[:5]
