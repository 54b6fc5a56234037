"""The nearest rows of each query, of all pairs of a block, by tiles of queries and rows.

Both sides of a block are dealt over tiles, and one task compares one tile of queries with one of rows: products in
single precision leave out what is surely behind the k-th, the others are worked out in double precision, component by
component, so that scores and ties don't depend on tiles. A task keeps at most two tiles, whatever the block's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a tile, queries multiplied with it at a time, and pairs worked out at a time.
TILE, AT_ONCE, PAIRS = 16_384, 256, 65_536


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows in double precision, added up from the first component to the last."""
    out = np.zeros(len(x))
    for c in range(x.shape[1]):
        out += x[:, c] * y[:, c]
    return out


class Side:
    """Ids and vectors of a tile; what has no vector of this length is `lost`, and zero."""

    def __init__(self, ids: np.ndarray, vectors: list, size: int, other: np.ndarray | None):
        self.id, self.other = ids, other
        self.lost = np.array([v is None for v in vectors], bool)
        self.x = np.zeros((len(ids), max(size, 1)))
        if size and not self.lost.all():
            self.x[~self.lost] = np.array([v for v in vectors if v is not None], float)
        self.n2 = exact(self.x, self.x)

    def first_of_equal(self, most: int) -> np.ndarray:
        """Of equal vectors the places of the `most` smallest ids: no others can be among the nearest."""
        key = np.ascontiguousarray(np.c_[self.x, self.lost])
        _, of = np.unique(key.view(f"V{8 * key.shape[1]}").ravel(), return_inverse=True)
        order = np.lexsort((np.unique(self.id, return_inverse=True)[1], of))
        return order[_places(of[order]) < most]


def _places(groups: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal values."""
    at = np.arange(len(groups))
    starts = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(starts, at, 0))


def _scores(q: Side, r: Side, i: np.ndarray, j: np.ndarray, cosine: bool) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        s = exact(q.x[a], r.x[b])
        if cosine:
            n = q.n2[a] * r.n2[b]
            s = s / np.sqrt(np.where(n == 0, 1.0, n))
            # as the SQL's function has it, of which no product is -1
            s = np.where(n == 0, 0.0, np.where(np.isnan(s), -1.0, np.clip(s, -1, 1)))
        else:
            s = np.where(q.lost[a] | r.lost[b], -np.inf, s)
        out[at : at + PAIRS] = s
    return out


def _best(q: Side, r: Side, k: int, cosine: bool, differ: bool) -> list[tuple[np.ndarray, ...]]:
    """Ids of queries and rows, scores, and whether `other` differs: the k nearest rows of each query by score, then id."""
    # a query may be among the rows, as often as its id is
    k_all = k + (int(np.unique(r.id, return_counts=True)[1].max()) if differ else 0)
    kept = r.first_of_equal(k_all)
    by_id = np.unique(r.id, return_inverse=True)[1]
    finite = bool(np.isfinite(q.n2).all() and np.isfinite(r.n2).all())
    n = np.sqrt(r.n2[kept])
    by = np.where(n > 0, n, 1.0)[:, None] if cosine else max(float(n.max()), 1e-300)
    left = (q.x / np.where(q.n2 > 0, np.sqrt(q.n2), 1.0)[:, None]).astype(np.float32)
    right = np.ascontiguousarray((r.x[kept] / by).astype(np.float32).T)
    slack = np.float32((q.x.shape[1] + 8) * 2.5e-7)
    out = []
    for at in range(0, len(q.id), AT_ONCE):
        s = left[at : at + AT_ONCE] @ right
        if not finite:
            # what has no finite product is worked out
            s = np.where(np.isfinite(s), s, np.float32(np.inf))
        if not cosine:
            s[:, r.lost[kept]] = -np.inf
        if s.shape[1] > k_all:
            kth = np.partition(s, s.shape[1] - k_all, axis=1)[:, s.shape[1] - k_all]
            if not finite:
                kth[:] = -np.inf
            i, j = np.nonzero(s >= (kth - slack)[:, None])
        else:
            i, j = (a.ravel() for a in np.indices(s.shape))
        i, j = i + at, kept[j]
        if differ:
            own = q.id[i] != r.id[j]
            i, j = i[own], j[own]
        score = _scores(q, r, i, j, cosine)
        order = np.lexsort((by_id[j], -np.where(np.isnan(score), np.inf, score), i))
        order = order[_places(i[order]) < k]
        i, j = i[order], j[order]
        known = () if q.other is None else (np.array([a is not None and b is not None and a != b for a, b in zip(q.other[i], r.other[j])], bool),)
        out.append((q.id[i], r.id[j], score[order], *known))
    return out


def _length(v) -> int:
    return -1 if v is None else len(v)


def _compared(k: int, cosine: bool, differ: bool, names: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What a task does with a tile of queries and one of rows. Vectors of different lengths have no product."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        asked, held = queries["v"].map(_length), rows["v"].map(_length)
        for n in asked.unique() if len(rows) else ():
            q = queries[asked == n]
            sides = [Side(f["id"].to_numpy(), [v if n >= 0 and m == n else None for v, m in zip(f["v"], has)], max(n, 0), f["other"].to_numpy() if "other" in f else None) for f, has in ((q, asked[asked == n]), (rows, held))]
            with np.errstate(all="ignore"):
                found += _best(*sides, k, cosine, differ)
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(names, zip(*found))} if found else {c: [] for c in names})

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, cosine: bool, differ: bool = False, tile: int = TILE) -> DataFrame:
    """q, r, score, rank (and `differs`): the k nearest rows of each query in its block, ties by the smaller r.

    queries and rows: block, id, v and, where `differs` is asked for, other. Scores are products, null where there is
    none, or with `cosine` cosines, 0 where a norm is 0 or there is none. With `differ` a row is not its own neighbour.
    """
    names = ["q", "r", "score", *(["differs"] if "other" in queries.columns else [])]
    sizes = [side.where("block is not null").groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias(name)) for side, name in ((queries, "_m"), (rows, "_n"))]
    tiles = sizes[0].join(sizes[1], "block")
    tiles = F.broadcast(tiles) if tiles.limit(TILE + 1).count() <= TILE else tiles

    def dealt(side: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        whole = F.when(F.forall("v", lambda c: c.isNotNull()), F.col("v"))
        met = side.where("id is not null").withColumn("v", whole).join(tiles, "block").withColumn(mine, F.pmod(F.xxhash64("id"), own).cast("int"))
        met = met.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_m", "_n")
        # columns of its own, as both sides may be one table
        return met.select(*(F.col(c).alias(c) for c in met.columns))

    keys = ["block", "_i", "_j"]
    a, b = dealt(queries, "_m", "_n", "_i", "_j"), dealt(rows, "_n", "_m", "_j", "_i")
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, (queries.schema["id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString(), "double", "boolean")))
    met = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(_compared(k, cosine, differ, names), schema)
    best = met.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "r"))).where(F.col("rank") <= k)
    return best if cosine else best.withColumn("score", F.when(F.col("score") > float("-inf"), F.col("score")))
