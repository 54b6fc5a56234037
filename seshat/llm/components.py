"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seshat.llm._io import discard, settle


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and, for each, the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each task's edges as stars around the smallest node it knows: at most one edge a node."""
    v = p = np.empty(0, np.int64)
    held: list[pd.DataFrame] = []
    size = 0
    for x in batches:
        held.append(x)
        size += len(x)
        if size >= 200_000:
            v, p = roots(np.concatenate([v, *(h.v.to_numpy() for h in held)]), np.concatenate([p, *(h.p.to_numpy() for h in held)]))
            held, size = [], 0
    if held or len(v):
        v, p = roots(np.concatenate([v, *(h.v.to_numpy() for h in held)]), np.concatenate([p, *(h.p.to_numpy() for h in held)]))
        keep = v != p
        yield pd.DataFrame({"v": v[keep], "p": p[keep]})


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(v, p): each node that is not the smallest of its component, and that smallest node.

    Edges are pairs of longs in columns a and b; loops, repeats and either direction are fine, nulls are left out,
    no edges give no rows. Each step is a minimum per node (summed up before the shuffle) and one join; the edges
    stay at most as many as the nodes after the first. Raises if `rounds` steps do not suffice.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("p"))
    e = settle(e.mapInPandas(_forest, "v long, p long").distinct())
    for _ in range(rounds):
        # done when every node has one parent and no parent has a parent
        tangled = e.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not tangled and not e.select(F.col("p").alias("v")).distinct().join(e.select("v"), "v", "left_semi").limit(1).count():
            return e
        both = e.select(F.col("v").alias("u"), F.col("p").alias("w")).union(e.select(F.col("p").alias("u"), F.col("v").alias("w")))
        low = settle(both.groupBy("u").agg(F.min("w").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        # a node with over a thousandth of the edges does not go through one task: there are fewer than two thousand
        most = (low.agg(F.sum("n")).first()[0] or 0) / 1000
        hot = F.broadcast(low.where(F.col("n") > most).select("u", "m"))
        met = both.join(hot, "u").unionByName(both.join(hot, "u", "left_anti").join(low.where(F.col("n") <= most).select("u", "m"), "u"))
        large = met.where("w > u").select(F.col("w").alias("v"), F.col("m").alias("p"))
        small = large.groupBy("v").agg(F.min("p").alias("m"))
        star = large.join(small, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("p")), F.struct(F.col("p").alias("v"), F.col("m").alias("p")))).alias("x")).select("x.*").where("v != p")
        new = settle(star.mapInPandas(_forest, "v long, p long").distinct())
        discard(e, low)
        e = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
