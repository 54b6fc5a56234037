"""Whitening of embeddings by the eigenvectors of their covariance, which is summed tile by tile.

Entries become integers, so sums are exact and whatever order they are added in gives the same means. Each Arrow batch
of rows is a block of rows; its columns are cut into blocks of TILE dimensions, and a block of columns goes to every
tile, a pair of blocks of dimensions, that it is part of: the key is block of rows and tile. There the two blocks are
centred and multiplied; a task adds up what it has of a tile and the tiles of all tasks are added after that. Blocks are
sent as differences from the nearest integers to the means, in the fewest bytes that hold them. Only the sums of the
dimensions and the finished tiles come to the driver: the square of the number of dimensions, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seshat.llm._io import groups

TILE, ROWS, SCALE, SHIFT = 32, 2048, 1024, 100_000
#: Beyond this an entry has no exact integer of its own in double precision.
MOST = 2.0**53


def finite(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: rows with a vector of finite entries; of several lengths the commonest, the longer of two as common."""
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    r = rows.where(good).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    lengths = r.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return r.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def integers(column: pa.Array) -> np.ndarray:
    """Rows of the long x = floor(1024 * c) + 100000 of each entry c."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64) + SHIFT


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension: halves of 32 bits are added up apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if len(batch):
                x = integers(batch.column(0))
                n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": np.arange(len(high), dtype=np.int32), "n": np.full(len(high), n), "high": high, "low": low})

    parts = rows.select("v").mapInArrow(run, "dim int, n long, high long, low long")
    total = parts.groupBy("dim").agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low"))).orderBy("dim").collect()
    return (int(total[0]["n"]) if total else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in total]


class Centre:
    """Means S / n as the nearest integer and the rest of it, so that x - S / n loses no digit of x."""

    def __init__(self, n: int, totals: list[int]):
        means = [Fraction(s, n) for s in totals]
        self.whole = np.array([round(m) for m in means], np.int64)
        self.rest = np.array([float(m - round(m)) for m in means])


def covariance(rows: DataFrame, centre: Centre, n: int) -> np.ndarray:
    """The covariance, divisor n, of the entries of rows."""
    dims = len(centre.whole)
    blocks = -(-dims // TILE)
    part = lambda k: slice(k * TILE, min(dims, (k + 1) * TILE))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                x = integers(batch.column(0).slice(a, ROWS)) - centre.whole
                block += 1
                out = []
                for k in range(blocks):
                    y = np.ascontiguousarray(x[:, part(k)])
                    size = next(s for s in (2, 4, 8) if s == 8 or abs(y).max() < 1 << (8 * s - 1))
                    packed = y.astype(f"<i{size}").tobytes()
                    out += [(block, min(k, j), max(k, j), k, size, packed) for j in range(blocks)]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["block", "i", "j", "k", "size", "y"]), preserve_index=False)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for g in groups(batches, "block", "i", "j"):
            i, j = int(g.i.iloc[0]), int(g.j.iloc[0])
            y = {int(k): np.frombuffer(b, f"<i{size}").reshape(-1, len(centre.rest[part(k)])) - centre.rest[part(k)] for k, size, b in zip(g.k, g["size"], g.y)}
            tiles[i, j] = tiles.get((i, j), 0) + y[i].T @ y[j]
        yield pd.DataFrame([(i, j, t.tobytes()) for (i, j), t in tiles.items()], columns=["i", "j", "tile"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, t in zip(b.i, b.j, b.tile):
                tiles[i, j] = tiles.get((i, j), 0) + np.frombuffer(t)
        yield pd.DataFrame([(i, j, t.tobytes()) for (i, j), t in tiles.items()], columns=["i", "j", "tile"])

    dealt = rows.select("v").mapInArrow(cut, "block long, i long, j long, k long, size long, y binary")
    partial = dealt.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "k").mapInPandas(multiply, "i long, j long, tile binary")
    total = partial.repartition("i", "j").mapInPandas(add, "i long, j long, tile binary").toPandas()
    out = np.zeros((dims, dims))
    for i, j, t in zip(total.i, total.j, total.tile):
        out[part(i), part(j)] = np.frombuffer(t).reshape(len(centre.rest[part(i)]), -1) / n
        out[part(j), part(i)] = out[part(i), part(j)].T
    return out


class Whitener:
    """Components numbered from 1 by falling eigenvalue, and what scales each to a variance of 1."""

    def __init__(self, v: np.ndarray, centre: Centre, most: int):
        values, vectors = np.linalg.eigh(v)
        trace, order = float(np.trace(v)), np.argsort(-values, kind="stable")[:most]
        self.centre, self.explained = centre, [float(e / trace) if trace > 0 else None for e in values[order]]
        #: A variance within the rounding of the largest is none: nothing can be scaled to 1 there.
        self.live = values[order] > len(v) * np.finfo(float).eps * max(values[-1], 0)
        scale = np.where(self.live, np.sqrt(np.where(self.live, values[order], 1)), np.nan)
        self.matrix = vectors[:, order] / scale

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre.whole - self.centre.rest) @ self.matrix


def deviations(x: np.ndarray, n: int, totals: list[int], whole: np.ndarray) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S)^2 of each row; null where no long holds it."""
    y, rest = x - whole, [s - n * int(w) for s, w in zip(totals, whole)]
    most = n * int(abs(y).max(initial=0)) + max(map(abs, rest))
    kind = np.int64 if most * most * len(rest) < 1 << 63 else object
    d = y.astype(kind) * n - np.array(rest, kind)
    return [int(v) if v < 1 << 63 else None for v in (d * d).sum(1)]


def identity_error(rows: DataFrame, whitener: Whitener, n: int) -> float | None:
    """The largest absolute entry of the covariance of the whitened rows minus the identity; null without components."""
    live = np.flatnonzero(whitener.live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(live), len(live)))
        for batch in batches:
            if len(batch):
                w = whitener(integers(batch.column(0)))[:, live]
                total += w.T @ w
        i, j = np.divmod(np.arange(total.size), max(1, len(live)))
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "s": total.ravel()})

    total = rows.select("v").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max((abs(r["s"] / n - (r["i"] == r["j"])) for r in total), default=None)


def whitened(rows: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each fitting row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part, nor those of another length
    than the commonest, which have no covariance with the rest. Each other entry c becomes x = floor(1024 * c) + 100000
    (beyond 2^53 before the shift it is 2^53), n rows with sums S. Components are numbered by falling eigenvalue, up to
    `most` or the number of dimensions. deviation is null where no long holds it. Where a component has no variance,
    as with one row or equal rows, whitened is null, explained 0 (null if nothing varies), and identity_error is of the
    others (null if none). Null ids and repeated rows stay rows of their own; an empty table gives an empty result;
    other columns are left out, whatever their names.
    """
    r = finite(rows, id_col, vector_col)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, totals = sums(r)
    if not n:
        return rows.sparkSession.createDataFrame([], out)
    centre = Centre(n, totals)
    whitener = Whitener(covariance(r, centre, n), centre, most)
    error = identity_error(r, whitener, n)
    parts = len(whitener.explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = integers(batch.column(1))
                far = deviations(x, n, totals, centre.whole)
                w, rows_ = whitener(x).ravel(), np.repeat(np.arange(len(x)), parts)
                columns = [
                    batch.column(0).take(pa.array(rows_)), pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(w), n)), pa.array(far, pa.int64()).take(pa.array(rows_)), pa.array(w, mask=np.isnan(w)),
                    pa.array(whitener.explained * len(x), pa.float64()), pa.array([error] * len(w), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in out.split(", ")])

    return r.select("id", "v").mapInArrow(project, out)
