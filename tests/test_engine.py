import json

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from quire import corpus as C
from quire.api import Document
from quire.plans.jq import JqError, Program
from quire.plans.queries import ORACLES, QUERIES
from quire.sources.pdf import SCHEMAS, files, register, view
from quire.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    return sorted((tuple(None if pd.api.types.is_scalar(x) and pd.isna(x) else round(x, 6) if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0 and set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for k, f in enumerate(C.FLAVOURS):
        (d / f"{f}.pdf").write_bytes(C.from_text(f"hello {k}\nworld", f))
    (d / "bad.pdf").write_bytes(b"nothing")
    return str(d)


def test_views(spark, folder):
    df = files(spark, folder).select("path", "content")
    for name in SCHEMAS:
        view(df, name).count()
    assert view(df, "documents").where("error is not null").count() == 1
    assert {r.text.split("\n")[1] for r in view(df, "document_text").collect()} == {"world"}
    assert view(df.limit(0), "spans").collect() == []


def test_data_source(spark, folder):
    register(spark)
    df = spark.read.format("quire-pdf").option("view", "document_text").load(folder + "/*.pdf")
    assert df.count() == len(C.FLAVOURS)
    assert df.where(df.path == f"{folder}/lzw.pdf").collect()[0].text == "hello 5\nworld"


def test_streaming(spark, folder, tmp_path):
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, folder, "document_text", str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(C.FLAVOURS)


def test_api(folder):
    d = Document(folder + "/objstm.pdf")
    assert d.page_count == len(d) == 1 and d[-1].extract_text() == "hello 6\nworld" == d.extract_text() and d.extract_markdown() == "hello 6\nworld" and d.version == "1.7" and d.get_object(1)["Type"] == "Catalog"
    assert "/Catalog" in d.show_object(1) and d.tree()["header"] == "%PDF-1.7" and d.render_pages([0])[0][:4] == b"\x89PNG" and d[0].size == (612, 792)
    with pytest.raises(IndexError):
        d[1]
    with pytest.raises(ValueError):
        Document()


@pytest.mark.parametrize(
    ("program", "want"),
    [
        (".", [{"a": [3, 1, {"b": 2}], "s": "hey"}]), (".a[0], .a[-1].b", [3, 2]), ("[.a[] | select(type == \"number\")] | sort", [[1, 3]]), ("{s, n: .a[1]}", [{"s": "hey", "n": 1}]), (".a | map(type) | unique", [["number", "object"]]), ("limit(2; .a[])", [3, 1]),
        ("if .s == \"hey\" then 1 elif true then 3 else 2 end", [1]), (".zz // 5", [5]), (".s | test(\"^h\")", [True]), (".a[1:] | length", [2]), ("-1 + 2 * 3", [5]), ("[.a[:2][] | . * 2] | add", [8]), (".a | sort_by(type) | .[0]", [3]), ("[.. | numbers_]?", None),
        ("[.a[:2][] | {k: (. % 2), v: .}] | group_by(.k) | map(length)", [[2]]), ("to_entries | map(.key)", [["a", "s"]]), ("has(\"a\") and (.a | length > 2)", [True]), ("[.a[]?, 1] | last", [1]), (".a | min, max", [1, {"b": 2}]),
    ],
)
def test_jq(program, want):
    x = {"a": [3, 1, {"b": 2}], "s": "hey"}
    if want is None:
        with pytest.raises(JqError, match=r"jq: .*byte \d+"):
            Program(program)
    else:
        assert json.loads(json.dumps(list(Program(program).run(x)))) == want


def test_jq_errors():
    for p in (".[", "foo", '"x', "{a", ".a |", "if . then 1"):
        with pytest.raises(JqError, match="byte"):
            Program(p)
    with pytest.raises(JqError):
        list(Program(".a.b").run({"a": [1]}))
