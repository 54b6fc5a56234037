"""Chunk graphs: NEXT and HOP edges, bounded expansion and best-first traversal over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seshat.operators.ordering import ahead

MOST_DEPTH = 4


def next_edges(rows: DataFrame, source: str, order: str, node: str, steps: int = 1) -> DataFrame:
    """src, dst: each chunk and the one after it, or `steps` on, in its source."""
    e = ahead(rows.select(source, order, F.col(node).alias("node")) if node not in (source, order) else rows.select(source, order).withColumn("node", F.col(node)), source, order, ["node"], steps)
    return e.select(F.col("node").alias("src"), F.col("next_node").alias("dst")).where("dst is not null")


def upserted_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """src, dst, kind, score: the union of both, the new score where an edge is in both."""
    both = new.withColumn("_age", F.lit(0)).unionByName(old.withColumn("_age", F.lit(1)))
    return both.groupBy("src", "dst", "kind").agg(F.min_by("score", F.struct("_age", -F.coalesce("score", F.lit(0.0)))).alias("score"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, depth: the fewest steps from each seed to each node, seeds themselves at 0.

    Rounds are joins of the frontier alone; each is cut from the lineage of the last by a checkpoint where the
    session has a folder for it.
    """
    frontier = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    seen = frontier
    for d in range(1, depth + 1):
        step = frontier.join(edges.select(F.col("src").alias("node"), F.col("dst")), "node").select("seed", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(d))
        if frontier.sparkSession.sparkContext.getCheckpointDir() is not None:
            frontier = frontier.checkpoint()
        seen = seen.unionByName(frontier)
    return seen


def best_first(edges: DataFrame, seeds: DataFrame, scores: DataFrame, k: int, depth: int, threshold: float, excluded: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, hop, rank: scored traversal of bounded depth.

    seeds: query_id, id, score; scores: query_id, id, score of any node for a query; edges: src, dst. The best
    max(1, min(k - 1, 10)) seeds open the frontier; each hop keeps the max(10, 6k) best neighbours that are not
    visited; those at the threshold are visited and go on; the best score of each node counts.
    """
    depth = max(1, min(MOST_DEPTH, depth))
    order = lambda: W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = lambda df: df if excluded is None else df.join(excluded, ["query_id", "id"], "left_anti")
    found = out(seeds.select("query_id", "id", "score")).withColumn("hop", F.lit(0))
    frontier = found.withColumn("r", F.row_number().over(order())).where(F.col("r") <= max(1, min(max(1, k - 1), 10))).select("query_id", "id")
    visited = frontier
    for d in range(1, depth + 1):
        near = frontier.join(edges.select(F.col("src").alias("id"), F.col("dst")), "id").select("query_id", F.col("dst").alias("id")).distinct()
        near = out(near).join(visited, ["query_id", "id"], "left_anti").join(scores, ["query_id", "id"])
        near = near.withColumn("r", F.row_number().over(order())).where(F.col("r") <= max(10, 6 * k)).select("query_id", "id", "score", F.lit(d).alias("hop"))
        if near.sparkSession.sparkContext.getCheckpointDir() is not None:
            near = near.checkpoint()
        found = found.unionByName(near)
        frontier = near.where(F.col("score") >= threshold).select("query_id", "id")
        visited = visited.unionByName(frontier).distinct()
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min("hop").alias("hop"))
    return best.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= k)
