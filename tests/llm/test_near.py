import random

import numpy as np
from test_simhash import brute_components

import corpus_pipeline as P
from quire.llm.near import confirmed, near_copies, node, shingle_sets, wide

SF = "/root/testdata/sf0.01"


def brute_set(t, width=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def near(a, b):
    both = len(a & b)
    return a == b or 9 * both >= 4 * (len(a) + len(b))


def brute_roots(rows):
    sets = {i: brute_set(t) for i, t in rows}
    return brute_components(sorted(sets), lambda a, b: near(sets[a], sets[b]))


def edited(r, n, share):
    base = [f"w{r.randrange(5000)}" for _ in range(n)]
    return " ".join(base), " ".join(w if r.random() > share else f"x{r.randrange(5000)}" for w in base)


def test_recall_and_precision(spark):
    """Pairs on both sides of 0.8, at lengths from six words on, against all pairs compared; none may be linked wrongly."""
    r = random.Random(1)
    texts = [t for n in (6, 12, 25, 60, 150, 400, 1500) for _ in range(60) for t in edited(r, n, r.choice([0.01, 0.02, 0.03, 0.05]))]
    rows = list(enumerate(texts))
    want = brute_roots(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {x.doc_id for x in P.near_dedup(spark, docs.selectExpr("*", "'en' lang", "'s' source", "1L n_chars"), SF).collect()}
    roots = {i for i in want if want[i] == i}
    pairs = len(rows) - len(roots)
    assert roots <= kept and pairs > 100 and len(kept - roots) <= 0.01 * pairs


def test_tables(spark):
    """The near copies of the test tables, of different texts and of the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    want = brute_roots(rows)
    assert {x.doc_id for x in P.near_dedup(spark, docs, SF).collect()} == {i for i in want if want[i] == i}


def test_dense(spark, docs, empty):
    """A large group of near copies, shuffled with the odd texts of the fixture."""
    r = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    rows = [(1000 + k, " ".join(w if r.random() > 0.01 else "x" for w in base)) for k in range(300)]
    rows += [(x.doc_id, x.text) for x in docs.collect() if x.doc_id is not None]
    sets = {}
    for i, t in rows:
        sets.setdefault(brute_set(t), i)
        sets[brute_set(t)] = min(i, sets[brute_set(t)])
    known = list(sets)
    want = brute_components(range(len(known)), lambda a, b: near(known[a], known[b]))
    got = {x.least: x.root for x in near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert set(got) == set(sets.values())
    tied = lambda group: sorted(sorted(v) for v in group.values())
    a, b = {}, {}
    for k, s in enumerate(known):
        a.setdefault(want[k], []).append(sets[s])
        b.setdefault(got[sets[s]], []).append(sets[s])
    assert tied(a) == tied(b) and near_copies(empty).collect() == []


def test_sets():
    import pyarrow as pa

    texts = ["", None, " \n", "A b", "a B", "a b c d e f", "É é", "a b c d e"]
    sets = list(shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [0, 0, 0, 1, 1, 2, 1, 1] and node(sets[3]) == node(sets[4]) != node(sets[7])
    assert not wide(sets[0]).any() and wide(sets[5]).shape == (4,) and set(sets[7]) < set(sets[5])


def test_confirmed():
    r = random.Random(4)
    sets = [np.array(sorted(r.sample(range(14), r.randint(5, 12))), np.uint64) for _ in range(120)]
    want = brute_components(range(120), lambda a, b: near(set(sets[a].tolist()), set(sets[b].tolist())))
    assert confirmed(sets).tolist() == [want[k] for k in range(120)] and confirmed([]).tolist() == []


def test_rows_not_ids(spark):
    """Repeated rows, ids with several texts, and rows without an id are decided row by row."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b), (None, a), (None, c), (None, c), (None, None), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted(((r.doc_id, r.text) for r in P.near_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, c), (5, None)], key=str)
