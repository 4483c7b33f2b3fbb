import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = SparkSession.builder.master("local[4]").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, shared passages, nulls, ties, empty and long texts, and extra columns with names that operators use within."""
    import random

    r = random.Random(5)
    word = lambda: r.choice(["alpha", "bêta", "gamma,", "x", "ones", "The", "of", "and"]) + r.choice(["", "s", "ing", "ö", "."])
    prose = lambda n: "".join(word() + r.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(n))
    shared = [prose(40) for _ in range(4)]
    base = [prose(r.randint(0, 160)) for _ in range(40)]
    texts = base + base[:10] + [b[: len(b) // 2] + r.choice(shared) + prose(20) + r.choice(shared) for b in base[:25]]
    texts += ["", None, " ", "\n", "one", "a" * 3000, "word " * 2000, " x y", "😀 " * 40, prose(5000)]
    r.shuffle(texts)
    rows = [(i * 7 - 50, t, r.choice(["en", None]), r.choice(["src0", "src0", "src1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(rows[3][0], rows[3][1], "en", "src0", 1), (None, base[2], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 block", "'x' part", "2 row", "'k' kept").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
