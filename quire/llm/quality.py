"""Quality classifier by hierarchical empirical Bayes (operator 8).

A logistic classifier fitted on labelled documents gives each document's evidence (log-odds of being unfit: low quality or toxic). Grouped aggregation of the evidence gives every host, and every path of a host,
a posterior rate: a path with few documents shrinks toward its host and a host toward the global rate, with prior weights estimated from the spread between sites. A document's score is its evidence plus what its path's
rate adds to the global log-odds; above zero it is rejected.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoints

#: At most so many labelled documents are fitted on: those of the least hashes of their ids.
FIT_DOCS = 6000
SALT = 32
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))  # ASCII punctuation
_STEPS = (0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8)
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")


def features(text: str) -> tuple[set[str], set[str], set[str]]:
    """Words without punctuation round them, beginnings of long words, and the shape of the whole text in steps."""
    tokens = text.split()
    words = set(map(_bare, text.lower().split()))
    n = len(tokens) or 1
    marks = _MARKS.findall(text.encode("utf-8", "replace"))
    shape = {m[:4].decode("latin-1") for m in set(marks)}
    counts = (
        ("again", sum(map(str.__eq__, tokens, tokens[1:]))), ("upper", sum(map(str.isupper, tokens))), ("marks", len(marks)), ("bars", tokens.count("|")), ("alike", n - len(set(tokens))),
    )
    shape |= {f"{k}{step}" for k, v in counts if v for step in _STEPS if v > step * n}
    return words, {w[:5] for w in words if len(w) > 5} | {w[:4] for w in words if len(w) > 4}, shape


def _bare(token: str, edge: str = _EDGE) -> str:
    return token.strip(edge)


class Model:
    """Weights by kind of feature; only those worth keeping."""

    def __init__(self, weights: tuple[dict[str, float], dict[str, float], dict[str, float]], bias: float):
        self.weights, self.bias = weights, bias

    def __call__(self, text: str | None) -> float:
        return self.bias + math.fsum(w[f] for w, found in zip(self.weights, features(text or ""), strict=True) for f in found & w.keys())


def fit(texts: list[str], bad: list[int], rounds: int = 300, least_docs: int = 3, surprise: float = 4.5, shrink: float = 5e-5) -> Model:
    """Logistic regression on the presence of those features whose share among unfit documents differs from that among the others by `surprise` standard errors, by full-batch gradient steps with a rate for each weight.

    Without both kinds of label there is nothing to learn: all are fit."""
    y = np.asarray(bad, float)
    if not len(y) or y.min() == y.max():
        return Model(({}, {}, {}), -3.0)
    number: dict[tuple[int, str], int] = {}
    rows = [np.fromiter((number.setdefault((k, f), len(number)) for k, found in enumerate(features(t)) for f in found), np.int64) for t in texts]
    ids = np.concatenate(rows)
    seen = np.bincount(ids, minlength=len(number))
    rate = y.mean()
    with_ = np.bincount(ids, np.repeat(y, [len(r) for r in rows]), len(number))
    z = (with_ - seen * rate) / np.sqrt(seen * rate * (1 - rate) * np.maximum(1 - seen / len(y), 1 / len(y)))
    keep = (seen >= min(least_docs, max(1, len(y) // 50))) & (np.abs(z) > min(surprise, 0.3 * math.sqrt(len(y))))
    new = np.cumsum(keep) - 1
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[keep[ids]]
    ids = new[ids[keep[ids]]]
    n, w, b = len(y), np.zeros(int(keep.sum())), math.log(y.mean() / (1 - y.mean()))
    square, square_b = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(b + np.bincount(row, w[ids], n)).clip(-30, 30)))
        g = np.bincount(ids, (p - y)[row], len(w)) / n + shrink * w
        square += g * g
        w -= 0.5 * g / np.sqrt(square)
        gb = (p - y).mean()
        square_b += gb * gb
        b -= 0.1 * gb / math.sqrt(square_b)
    names = [f for f, k in zip(number, keep, strict=True) if k]
    weights: tuple = ({}, {}, {})
    for (kind, f), x in zip(names, w.tolist(), strict=True):
        if abs(x) > 0.01:
            weights[kind][f] = round(x, 4)
    return Model(weights, float(b))


def fit_labels(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> Model:
    """A model from at most `most` labelled documents (doc_id, quality 0 or 1, toxic 0 or 1); a null label counts as fit."""
    some = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # one row of each labelled id, that of its least text
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("bad").alias("bad")).orderBy("doc_id").select("text", "bad").collect()
    return fit([r[0] or "" for r in rows], [r[1] for r in rows])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def judge(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns to keep (all) of docs, and evidence, host_rate, path_rate, quality_score (log-odds of being unfit) and rejected.

    docs: doc_id, text and the two site columns. A null text counts as empty, a null host or path as one of its own; rows are judged each for itself, so repeated rows stay. An empty table gives an empty table. Each document is
    scored once; scores (with what is kept) are written to the shared folder, as the rates need all of them first. Sites are aggregated before they are shuffled; documents meet the site table by a join that Spark
    broadcasts only if it is measured to be small, and whose hot keys are salted.
    """
    spark = docs.sparkSession
    checkpoints(spark)
    held, names = spark.sparkContext.broadcast(model), list(docs.columns if keep is None else keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(1, b.num_columns)), pa.array([m(t) for t in b.column(0).to_pylist()], pa.float64())], [*b.schema.names[1:], "evidence"])

    # numbered columns, as docs may have any names
    site = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(n) for c, n in ((host, "h"), (path, "p"))]  # a null is a site of its own
    inner = docs.select(F.col("text").alias("t"), *site, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    folder = f"{spark.sparkContext.getCheckpointDir()}/judged-{uuid.uuid4().hex}"
    inner.mapInArrow(score, ", ".join(f"{n} {k}" for n, k in inner.dtypes[1:]) + ", evidence double").write.parquet(folder)
    scored = spark.read.parquet(folder)
    rates = site_rates(scored.groupBy("h", "p").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / (1 + F.exp(-F.col("evidence")))).alias("bad")))
    # a hot site's documents are dealt over SALT keys; the site table has a row for each
    salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    scored = scored.withColumn("own_salt", F.pmod(F.xxhash64("evidence"), F.lit(SALT)).cast("int"))
    full = scored.join(salted, (F.col("h") == F.col("site_host")) & (F.col("p") == F.col("site_path")) & (F.col("own_salt") == F.col("salt")))
    odds = F.col("evidence") + _logit(F.col("path_rate")) - _logit(F.col("global_rate"))
    return full.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "evidence", "host_rate", "path_rate", odds.alias("quality_score"), (odds > 0).alias("rejected"))


def site_rates(paths: DataFrame) -> DataFrame:
    """(site_host, site_path, host_rate, path_rate, global_rate) from (h, p, n, bad) of each path."""
    hosts = paths.groupBy("h").agg(F.sum("n").alias("hn"), F.sum("bad").alias("hbad"))
    row = hosts.agg(F.sum("hn").alias("n"), F.sum("hbad").alias("bad")).first()
    g = min(0.999, max(0.001, ((row["bad"] or 0) + 0.5) / ((row["n"] or 0) + 1)))
    k = _prior_weight(hosts.select(F.col("hn").alias("n"), (F.col("hbad") / F.col("hn")).alias("r"), F.lit(g).alias("up")))
    hosts = hosts.withColumn("host_rate", (F.col("hbad") + k * g) / (F.col("hn") + k))
    both = paths.join(hosts, "h")
    m = _prior_weight(both.select("n", (F.col("bad") / F.col("n")).alias("r"), F.col("host_rate").alias("up")))
    clip = lambda c: F.greatest(F.lit(0.001), F.least(F.lit(0.999), c))
    return both.select(F.col("h").alias("site_host"), F.col("p").alias("site_path"), clip(F.col("host_rate")).alias("host_rate"), clip((F.col("bad") + m * F.col("host_rate")) / (F.col("n") + m)).alias("path_rate"), F.lit(g).alias("global_rate"))


def _prior_weight(sites: DataFrame) -> float:
    """The prior's weight in documents: how far rates within sites vary, over how far they vary between sites beyond that (method of moments)."""
    d = (F.col("r") - F.col("up")) ** 2
    within = F.col("up") * (1 - F.col("up"))
    row = sites.agg(F.sum(F.col("n") * d).alias("between"), F.sum(within).alias("chance"), F.sum("n").alias("n"), F.sum(F.col("n") * within).alias("within")).first()
    if not row["n"]:
        return 100.0
    spread = (row["between"] - row["chance"]) / row["n"]
    return float(min(1e6, max(10.0, (row["within"] / row["n"]) / spread))) if spread > 0 else 1e6
