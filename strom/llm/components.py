"""Connected components of links that only exist as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strom.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of star contraction over edges with a > b: each node hands its neighbours to the smallest of them.

    Large star: larger neighbours. Small star: the smaller ones and itself. A node's minimum is combined before it is
    shuffled and then joined, so no node's neighbours are gathered.
    """
    sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = sides.groupBy("a").agg(F.min("b").alias("_least")).select("a", F.least("a", "_least").alias("_least"))
    joined = sides.join(least, "a")
    if large:
        handed = joined.where("b > a").select(F.col("_least").alias("b"), F.col("b").alias("a"))
    else:
        handed = joined.select(F.col("_least").alias("b"), F.col("b").alias("a")).unionByName(least.select(F.col("_least").alias("b"), "a"))
    return handed.where("a <> b").select("a", "b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node that points to a smaller one does so once and is pointed to by none, so each edge names its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    open_nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("ends")).where("up > 0 and ends > 1")
    return not open_nodes.agg(F.count(F.lit(1))).first()[0]


def connect(links: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest id reachable, for every id in the links (columns centre and doc_id).

    Alternates both stars until every edge leads to the smallest id of its component, which takes rounds in the logarithm of the
    longest path squared at most. Each round is written to the shared folder; only a count comes to the driver. The driver keeps
    plan, stages and tasks of every round as long as the session lasts, so no round is run to see that nothing changes any more.
    """
    edges = links.select(F.greatest("centre", "doc_id").alias("a"), F.least("centre", "doc_id").alias("b")).where("a <> b").distinct()
    edges = cut_lineage(edges)
    while not _settled(edges):
        edges = cut_lineage(_star(_star(edges, True), False))
    ids = edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))
    return ids.unionByName(edges.select(F.col("b").alias("doc_id"), F.col("b").alias("component")).distinct())
