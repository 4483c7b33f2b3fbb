import random

import pytest

import corpus_pipeline as P
from quire.llm.phrases import dedup_phrases
from quire.llm.quality import FIT_DOCS, Model, fit, fit_labels, judge, site_rates

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """Fitted on four fifths of the labelled documents; junk and toxic ones among the rest are found and clean ones kept."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.join(labels, "doc_id").selectExpr("doc_id", "text", "int(quality = 0 or toxic = 1) bad").orderBy("doc_id").collect()
    right = n = clean_lost = clean = 0
    for fold in range(5):
        train = [r for k, r in enumerate(rows) if k % 5 != fold]
        m = fit([r.text or "" for r in train], [r.bad for r in train])
        for k, r in enumerate(rows):
            if k % 5 == fold:
                out = int(m(r.text) > 0)
                right, n = right + (out == r.bad), n + 1
                clean, clean_lost = clean + (not r.bad), clean_lost + (not r.bad and out)
    assert right / n > 0.95 and clean_lost / clean < 0.01


def test_fit_edges():
    assert fit([], [])("x") < 0 and fit(["a", "b"], [0, 0])(None) < 0 and fit(["a"], [1])("a") < 0
    m = fit(["bad word here", "fine words", "bad thing", "good text"] * 20, [1, 0, 1, 0] * 20)
    assert m("bad") > 0 > m("fine") and FIT_DOCS == 6000


def test_judge(docs, empty, spark):
    m = Model(({"alpha": 0.5}, {}, {}), -1.0)
    got = judge(docs, m).collect()
    assert len(got) == docs.count() and set(docs.columns) < set(got[0].asDict())
    assert all((r.quality_score > 0) == r.rejected and 0 < r.path_rate < 1 for r in got)
    assert judge(empty, m).collect() == []
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert fit_labels(docs, labels)("x") < 0


def test_shrinkage(spark):
    rows = [("a", "x", 1000, 900.0), ("a", "y", 1, 0.0), ("b", "x", 1000, 10.0), ("b", "z", 1, 1.0), ("c", "x", 1, 1.0), ("d", "x", 500, 60.0)]
    got = {(r.site_host, r.site_path): r for r in site_rates(spark.createDataFrame(rows, "h string, p string, n long, bad double")).collect()}
    g = got["c", "x"].global_rate
    assert got["a", "x"].path_rate > 0.8 and got["b", "x"].path_rate < 0.05
    assert abs(got["c", "x"].path_rate - g) < 0.25 and abs(got["a", "y"].path_rate - got["a", "y"].host_rate) < 0.1 and abs(got["b", "z"].path_rate - got["b", "z"].host_rate) < 0.12


def plain_rates(rows):
    """The rates of sites straight from the formulas, row by row."""
    hosts = {}
    for h, _, n, bad in rows:
        a = hosts.setdefault(h, [0, 0.0])
        a[0], a[1] = a[0] + n, a[1] + bad
    n, bad = sum(x[0] for x in hosts.values()), sum(x[1] for x in hosts.values())
    g = min(0.999, max(0.001, (bad + 0.5) / (n + 1)))

    def weight(sites):
        between, chance = sum(n * (r - up) ** 2 for n, r, up in sites), sum(up * (1 - up) for _, _, up in sites)
        total, within = sum(n for n, _, _ in sites), sum(n * up * (1 - up) for n, _, up in sites)
        spread = (between - chance) / total
        return min(1e6, max(10.0, within / total / spread)) if spread > 0 else 1e6

    k = weight([(n, b / n, g) for n, b in hosts.values()])
    rate = {h: (b + k * g) / (n + k) for h, (n, b) in hosts.items()}
    m = weight([(n, b / n, rate[h]) for h, _, n, b in rows])
    clip = lambda x: min(0.999, max(0.001, x))
    return {(h, p): (clip(rate[h]), clip((b + m * rate[h]) / (n + m)), g) for h, p, n, b in rows}


def test_sparse_sites(spark):
    """Many sites of one or two documents beside a few large ones, against the formulas; a sparse path lies nearer its host's rate than its own, and a sparse host nearer the global one."""
    import random

    r = random.Random(9)
    rows = [(f"h{h}", f"p{p}", n, round(n * r.betavariate(1, 4), 3)) for h in range(60) for p in range(r.randint(1, 6)) for n in [r.choice([1, 1, 1, 2, 3, 40, 900])]]
    got = {(x.site_host, x.site_path): (x.host_rate, x.path_rate, x.global_rate) for x in site_rates(spark.createDataFrame(rows, "h string, p string, n long, bad double")).collect()}
    want = plain_rates(rows)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    for h, p, n, bad in rows:
        host, path, g = got[h, p]
        if n == 1 and 0.002 < path < 0.998:
            assert abs(path - host) <= abs(bad / n - host) * 0.2 + 1e-9
    assert site_rates(spark.createDataFrame([], "h string, p string, n long, bad double")).collect() == []


def test_null_sites(spark):
    """A null host isn't the empty one."""
    rows = [(1, "alpha " * 3, None), (2, "alpha " * 3, ""), (3, "beta", ""), (4, "beta", "")] + [(9 + k, "alpha", "x") for k in range(40)]
    got = {x.doc_id: x.host_rate for x in judge(spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' lang"), Model(({"alpha": 5.0}, {}, {}), -2.0)).collect()}
    assert got[1] != got[2] and got[2] == got[3]


def test_odd_rows_pass_all_stages(spark, tmp_path, docs, empty):
    """Nulls in any column, repeated rows and ids, clashing columns and an empty table go through every stage."""
    for name, rows in (("odd", docs), ("none", empty)):
        folder = tmp_path / name
        spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(folder / "labels.parquet"))
        rows.write.parquet(str(folder / "documents.parquet"))
        last = spark.read.parquet(str(folder / "documents.parquet"))
        for stage, f in P.STAGES[:-1]:
            last = f(spark, last, str(folder))
            assert tuple(last.columns) == P.COLUMNS
            last.write.parquet(str(folder / stage))
            last = spark.read.parquet(str(folder / stage))
        packed = P.run(spark, str(folder))
        assert packed.select("doc_id").distinct().count() == last.select("doc_id").distinct().count()
        assert (packed.count() == 0) == (name == "none")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [spark.read.parquet(f"{SF}/documents.parquet")], None
    for name, f in P.STAGES:
        p = str(tmp_path_factory.mktemp(name) / "out")
        f(spark, out[-1], SF).write.parquet(p)
        out.append(spark.read.parquet(p))
    return out


def test_pipeline(spark, stages):
    docs, good, single, cut, packed = stages
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "packing"] and P.ORACLE_SQL is None
    assert all(tuple(x.columns) == P.COLUMNS for x in (good, single, cut))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    known = [r for i, r in labels.items()]
    clean = [r for r in known if r.quality and not r.toxic]
    assert sum(r.doc_id in kept for r in clean) >= 0.99 * len(clean) and sum(r.doc_id in kept for r in known if r not in clean) <= 0.05 * len(known)
    from test_near import brute_roots

    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = brute_roots(rows)
    assert {r.doc_id for r in single.collect()} == {i for i in want if want[i] == i} and single.count() < good.count()
    from test_windows import brute_phrases

    rows = sorted((r.doc_id, r.text) for r in single.collect())
    want = {i: (t if not n else k) for (i, t), (_, _, n, k) in zip(rows, brute_phrases(rows, 20))}
    assert {r.doc_id: r.text for r in cut.collect()} == want and all(r.n_chars == len(r.text) for r in cut.collect())
    tokens = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in tokens} == set(want) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in tokens)
    total = packed.groupBy("sequence_id").sum("length").selectExpr("count(*) n", "max(`sum(length)`) m", "sum(`sum(length)`) s").first()
    assert total.m <= 2048 and total.n * 2048 < 1.02 * total.s


def test_run(spark, stages):
    from pyspark.sql import functions as F

    total = lambda df: df.agg(F.count(F.lit(1)), F.sum("length"), F.countDistinct("doc_id")).first()
    got, want = total(P.run(spark, SF)), total(stages[-1])
    assert got[1:] == want[1:]


def test_carry_text(docs):
    out = dedup_phrases(docs, carry=("text", "lang")).collect()
    assert len(out) == docs.count()
