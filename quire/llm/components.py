"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoints


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (a long, b long) other than roots; root is the least node reachable.

    Alternating large and small stars: each node's larger neighbours are tied to its least neighbour, then its smaller ones, until nothing changes
    (rounds grow with the logarithm of the longest path). Each round is cut by a checkpoint in the shared folder. A node with very many links costs its aggregate
    one partial row for each task, and its join side can be split. Null links are left out.
    """
    checkpoints(links.sparkSession)
    edges = links.where("a != b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct().checkpoint()
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        edges = both.where("b > a").join(least, "a").selectExpr("b a", "m b").where("a != b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(least, "a").selectExpr("explode(array(struct(a, m b), struct(b a, m b))) e").selectExpr("e.a a", "e.b b").where("a != b").distinct().checkpoint()
        was, state = state, _state(edges)
        if was == state:
            break
    return edges.selectExpr("a node", "b root")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr("cast(xxhash64(a, b) as decimal(20, 0))")), F.lit(0))).first())
