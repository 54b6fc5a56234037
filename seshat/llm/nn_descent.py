"""Approximate nearest neighbours by inner product: NN-descent builds a graph, greedy search answers queries.

Equal vectors are one node (a class), so a vector that is repeated without end is one row. Vectors are parted into
bands of norms within a factor of four, and each band is a graph of its own: its nodes carry their vectors scaled to
unit length with one more component (largest inner product becomes largest cosine), in half precision. The scores
returned are computed in double precision on the vectors as given, and the bands' answers are merged by them; a few
very long vectors so leave the search among the others as it is.

1. Start: rows are dealt over leaves of TREES random-projection trees, fitted on at most SAMPLE vectors; each node's
   nearest within its leaves are its first neighbours.
2. NN-descent rounds: node v is joined with the vectors of its neighbours and of the nodes that count v among theirs
   (the best K), all pairs among them are scored there, and each of them is sent the best it does not know. Rounds go
   on until fewer than a stated share of all neighbours are new.
3. Search: a query starts from its own node, and in the other bands from the best of a sample; it keeps the `beam`
   best nodes found and expands those not yet expanded, a join a round, until none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seshat.llm._io import discard, groups, settle

K, TREES, LEAF, SAMPLE, SENT = 20, 4, 800, 8192, 8
#: Steps of the logarithm of the norm to the base 2, steps in a band, and nodes from which other bands are entered.
STEPS, BAND, ENTRIES, STARTS = 8, 16, 2048, 32
HALF = np.float16


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x array<double>: rows with an id and a finite vector other than zero; of several lengths the commonest."""
    x = F.col(vector_col)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    r = rows.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x"))
    lengths = r.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return r.where(F.size("x") == (lengths[0]["n"] if lengths else 0))


class Trees:
    """Random hyperplanes with medians of a sample; the deepest levels have one plane each."""

    def __init__(self, sample: np.ndarray, depth: int, own: int = 9):
        self.depth, self.own = depth, own
        rng = np.random.default_rng(4)
        self.planes, self.cuts = [], []
        for _ in range(TREES):
            planes, cuts = {}, {}
            code = np.zeros(len(sample), np.int64)
            for level in range(depth):
                for node in np.unique(code) if level < own else [-1]:
                    at = sample[code == node] if level < own and (code == node).sum() > 4 else sample
                    w = at[rng.integers(len(at))] - at[rng.integers(len(at))] if level < own else rng.standard_normal(sample.shape[1])
                    planes[level, int(node)] = w.astype(np.float32)
                    cuts[level, int(node)] = float(np.median(at @ w))
                code = self._step(sample, code, level, planes, cuts)
            self.planes.append(planes)
            self.cuts.append(cuts)

    def _step(self, x: np.ndarray, code: np.ndarray, level: int, planes: dict, cuts: dict) -> np.ndarray:
        up = np.zeros(len(x), np.int64)
        if level >= self.own:
            up = (x @ planes[level, -1] > cuts[level, -1]).astype(np.int64)
        else:
            for node in np.unique(code):
                at = code == node
                if (level, int(node)) in planes:
                    up[at] = x[at] @ planes[level, int(node)] > cuts[level, int(node)]
        return code * 2 + up

    def leaf(self, x: np.ndarray, tree: int) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            code = self._step(x, code, level, self.planes[tree], self.cuts[tree])
        return code


def step_of(x: Column) -> Column:
    """The step of the logarithm of a vector's norm, without squares that overflow."""
    most = F.array_max(F.transform(x, F.abs))
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v / most) * (v / most))
    return F.floor(STEPS * (F.log2(most) + F.log2(squares) / 2)).cast("int")


def bands(counts: dict[int, int]) -> list[tuple[int, int]]:
    """(highest step, nodes) of each band, from the nodes of each step: a band holds BAND steps from its highest down."""
    out: list[tuple[int, int]] = []
    for k in sorted(counts, reverse=True):
        if out and out[-1][0] - k < BAND:
            out[-1] = (out[-1][0], out[-1][1] + counts[k])
        else:
            out.append((k, counts[k]))
    return out


def _pack(ids: np.ndarray, scores: np.ndarray) -> tuple[bytes, bytes]:
    return ids.astype(np.int64).tobytes(), scores.astype(np.float32).tobytes()


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of ids, each once, without `own`; ties to the smaller id."""
    keep = ids != own
    ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:k]]
    return ids[order], scores[order]


def _merged(found: DataFrame) -> DataFrame:
    """node, ids, scores (bytes), fresh: the K best of all rows of a node, and how many of them no `old` row had."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in groups(batches, "node"):
            node = int(g.node.iloc[0])
            ids, scores = _best(np.frombuffer(b"".join(g.ids), np.int64), np.frombuffer(b"".join(g.scores), np.float32), node, K)
            known = np.frombuffer(b"".join(g.ids[g.old]), np.int64)
            out.append((node, *_pack(ids, scores), int((~np.isin(ids, known)).sum())))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=["node", "ids", "scores", "fresh"])
                out = []
        yield pd.DataFrame(out, columns=["node", "ids", "scores", "fresh"])

    return found.repartition("node").sortWithinPartitions("node").mapInPandas(run, "node long, ids binary, scores binary, fresh int")


def _started(vectors: DataFrame, trees: list[Trees]) -> DataFrame:
    """The first graph, from the leaves of the trees of each band."""
    held = vectors.sparkSession.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                for band, rows in b.groupby("band"):
                    x = np.frombuffer(b"".join(rows.v), HALF).reshape(len(rows), -1).astype(np.float32)
                    for t in range(TREES):
                        leaf = (held.value[band].leaf(x, t) * len(held.value) + band) * TREES + t
                        yield pd.DataFrame({"leaf": leaf, "node": rows.node, "v": rows.v})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "leaf"):
            parts = max(1, round(len(g) / (2 * LEAF)))
            for p in range(parts):  # a leaf that came out large is compared in parts
                part = g.iloc[p::parts]
                node = part.node.to_numpy()
                x = np.frombuffer(b"".join(part.v), HALF).reshape(len(part), -1).astype(np.float32)
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                k = min(K, len(part) - 1)
                if k < 1:
                    continue
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                rows = [_pack(node[a], s[i, a]) for i, a in enumerate(at)]
                yield pd.DataFrame({"node": node, "ids": [r[0] for r in rows], "scores": [r[1] for r in rows]})

    dealt = vectors.mapInPandas(deal, "leaf long, node long, v binary").repartition("leaf").sortWithinPartitions("leaf", "node")
    return _merged(dealt.mapInPandas(near, "node long, ids binary, scores binary").withColumn("old", F.lit(False)))


def _members(graph: DataFrame) -> DataFrame:
    """node, other: the neighbours of each node and the best K of the nodes that have it as a neighbour."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [len(x) // 8 for x in b.ids]
            if sum(n):
                yield pd.DataFrame({"a": np.repeat(b.node.to_numpy(), n), "b": np.frombuffer(b"".join(b.ids), np.int64), "s": np.frombuffer(b"".join(b.scores), np.float32)})

    e = graph.mapInPandas(edges, "a long, b long, s float")
    back = e.withColumn("nth", F.row_number().over(W.partitionBy("b").orderBy(F.desc("s"), "a"))).where(F.col("nth") <= K)
    return e.select(F.col("a").alias("node"), F.col("b").alias("other")).union(back.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()


def _descended(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """One NN-descent round."""
    joined = _members(graph).join(vectors.select(F.col("node").alias("other"), "v"), "other")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in groups(batches, "node"):
            ids = g.other.to_numpy()
            if len(ids) < 2:
                continue
            x = np.frombuffer(b"".join(g.v), HALF).reshape(len(g), -1).astype(np.float32)
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            k = min(SENT, len(ids) - 1)
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            out += [(int(a), *_pack(ids[c], s[i, c])) for i, (a, c) in enumerate(zip(ids, at))]
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=["node", "ids", "scores"])
                out = []
        yield pd.DataFrame(out, columns=["node", "ids", "scores"])

    sent = joined.repartition("node").sortWithinPartitions("node", "other").mapInPandas(local, "node long, ids binary, scores binary")
    return _merged(graph.select("node", "ids", "scores", F.lit(True).alias("old")).union(sent.withColumn("old", F.lit(False))))


def _searched(graph: DataFrame, vectors: DataFrame, queries: DataFrame, entries: list[tuple[np.ndarray, np.ndarray]], beam: int) -> DataFrame:
    """query (a node), band, ids, scores (bytes): the beam of each query's greedy search in each band.

    entries: nodes and vectors of a sample of each band.
    """
    spark = graph.sparkSession

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in groups(batches, "node"):
            out.append((int(g.node.iloc[0]), g.other.to_numpy(np.int64).tobytes(), b"".join(g.v)))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["node", "near", "vs"])
                out = []
        yield pd.DataFrame(out, columns=["node", "near", "vs"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = _members(graph).join(vectors.select(F.col("node").alias("other"), "v"), "other")
    table = joined.repartition("node").sortWithinPartitions("node", "other").mapInPandas(nodes, "node long, near binary, vs binary")
    table = settle(table).repartition(parts, "node").persist(StorageLevel.MEMORY_AND_DISK)
    held = spark.sparkContext.broadcast(entries)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for node, own, v in zip(b.node, b.band, b.v):
                q = np.frombuffer(v, HALF).astype(np.float32)
                for band, (ids, x) in enumerate(held.value):
                    if band == own:
                        near, s = np.array([node]), np.array([2.0])
                    else:
                        s = x[:, :-1] @ q[:-1]
                        best = np.argsort(-s, kind="stable")[:STARTS]
                        near, s = ids[best], s[best]
                    out.append((node, band, v, *_pack(near, s), np.zeros(len(near), bool).tobytes()))
            yield pd.DataFrame(out, columns=["query", "band", "v", "ids", "scores", "done"])

    # query, band, the query's vector, the beam, which of it is expanded
    beams = "query long, band int, v binary, ids binary, scores binary, done binary"
    state = settle(queries.join(vectors, "node").select("node", "band", "v").mapInPandas(begin, beams))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 200):
                part, node, at, floor = b.iloc[i : i + 200], [], [], []
                for r, (ids, scores, done) in enumerate(zip(part.ids, part.scores, part.done)):
                    new = np.frombuffer(ids, np.int64)[np.frombuffer(done, bool) == 0]
                    low = -2.0 if len(ids) < 8 * beam else float(np.frombuffer(scores, np.float32).min())
                    node.append(new)
                    at += [r] * len(new)
                    floor += [low] * len(new)
                own, band, vs = part["query"].to_numpy(), part.band.to_numpy(), part.v.to_numpy()
                yield pd.DataFrame({"query": own[at], "band": band[at], "v": vs[at], "node": np.concatenate(node).astype(np.int64), "floor": np.array(floor, np.float32)})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids_out, scores_out = [], []
            for v, floor, near, vs in zip(b.v, b.floor, b.near, b.vs):
                ids, q = np.frombuffer(near, np.int64), np.frombuffer(v, HALF).astype(np.float32)
                q[-1] = 0  # a query has no added component: what is left is its inner product
                s = np.frombuffer(vs, HALF).reshape(len(ids), -1).astype(np.float32) @ q
                keep = s > floor
                ids_out.append(ids[keep].tobytes())
                scores_out.append(s[keep].tobytes())
            yield pd.DataFrame({"query": b["query"], "band": b.band, "ids": ids_out, "scores": scores_out})

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in groups(batches, "query", "band"):
            own, found = g[g.v.notna()].iloc[0], g[g.v.isna()]
            old = np.frombuffer(own.ids, np.int64)
            ids = np.concatenate([old, np.frombuffer(b"".join(found.ids), np.int64)])
            scores = np.concatenate([np.frombuffer(own.scores, np.float32), np.frombuffer(b"".join(found.scores), np.float32)])
            ids, scores = _best(ids, scores, -(1 << 62), beam)
            out.append((own["query"], own.band, own.v, *_pack(ids, scores), np.isin(ids, old).tobytes()))
            if len(out) >= 500:
                yield pd.DataFrame(out, columns=["query", "band", "v", "ids", "scores", "done"])
                out = []
        yield pd.DataFrame(out, columns=["query", "band", "v", "ids", "scores", "done"])

    none = F.lit(None).cast("binary")
    # a row of the table holds the vectors of forty nodes: fewer of them at a time, for the memory of the tasks
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(batch)
    spark.conf.set(batch, str(min(int(usual), 1000) if int(usual) > 0 else 1000))
    while True:  # a node is expanded once at most, and only beams that still rise expand any
        asked = state.mapInPandas(ask, "query long, band int, v binary, node long, floor float")
        met = asked.repartition(parts, "node").join(table, "node").select("query", "band", "v", "floor", "near", "vs").mapInPandas(score, "query long, band int, ids binary, scores binary")
        met = met.where(F.length("ids") > 0).select("query", "band", none.alias("v"), "ids", "scores", none.alias("done"))
        after = settle(state.union(met).repartition("query", "band").sortWithinPartitions("query", "band").mapInPandas(keep, beams))
        discard(state)
        state = after
        if not state.where(F.instr(F.hex("done"), "00") > 0).limit(1).count():
            break
    spark.conf.set(batch, usual)
    table.unpersist()
    return state.select("query", "band", "ids", "scores")


def neighbours(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, top: int = 20, share: float = 0.02, beam: int = 320) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its `top` nearest other rows found.

    Nearest is the largest inner product; ties go to the smaller id; fewer rows than `top` are all given. NN-descent
    goes on until fewer than `share` of all neighbours are new. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor rows without an id, nor vectors of another length than the commonest,
    which have no product with the others. Rows that repeat an id and vector are one. An empty table gives an empty
    result. Other columns are left out.
    """
    r = valid(rows, id_col, vector_col).withColumn("cls", F.xxhash64("x"))
    # of equal vectors, the smallest ids that any answer can need; fewer than top + 2 a class leave each task
    members = r.select("cls", "id", "x").distinct().withColumn("nth", F.row_number().over(W.partitionBy("cls").orderBy("id"))).where(F.col("nth") <= top + 1)
    members = settle(members)
    nodes = members.where("nth = 1").select(F.col("id").alias("node"), "cls", "x")
    # at most a few thousand steps lie between the smallest and the largest double
    split = bands({x["step"]: x["n"] for x in nodes.groupBy(step_of(F.col("x")).alias("step")).agg(F.count("*").alias("n")).collect()})
    if not split:
        return members.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    tops = np.array([k for k, _ in split])

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                band = np.searchsorted(-tops, -b.step.to_numpy(), "right") - 1
                x = np.stack(b.x.to_numpy()).astype(np.float64) * np.exp2(-(tops[band] + 1.0) / STEPS)[:, None]
                rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
                yield pd.DataFrame({"node": b.node, "band": band, "v": [v.tobytes() for v in np.concatenate([x, rest[:, None]], 1).astype(HALF)]})

    vectors = settle(nodes.withColumn("step", step_of(F.col("x"))).select("node", "step", "x").mapInPandas(scaled, "node long, band int, v binary"))
    drawn = W.partitionBy("band").orderBy(F.xxhash64(F.lit(5), "node"), "node")
    sample = vectors.withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= max(256, SAMPLE // len(split))).orderBy("band", "nth").toPandas()
    trees, entries = [], []
    for band, (_, n) in enumerate(split):
        part = sample[sample.band == band]
        x = np.frombuffer(b"".join(part.v), HALF).reshape(len(part), -1).astype(np.float32)
        trees.append(Trees(x, max(0, int(np.ceil(np.log2(n / LEAF))))))
        entries.append((part.node.to_numpy()[:ENTRIES], x[:ENTRIES]))
    graph = settle(_started(vectors, trees))
    graph = settle(graph.join(vectors.select("node"), "node", "right").select("node", F.coalesce("ids", F.lit(b"")).alias("ids"), F.coalesce("scores", F.lit(b"")).alias("scores")))
    while True:
        new = settle(_descended(graph, vectors))
        discard(graph)
        graph = new
        fresh, all_ = graph.agg(F.sum("fresh"), F.sum(F.length("ids") / 8)).first()
        if (fresh or 0) <= share * (all_ or 0):
            break
    asked = r.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "cls").distinct()
    starts = nodes.join(asked.select("cls").distinct(), "cls", "left_semi").select("node")
    found = _searched(graph, vectors, starts, entries, beam)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q, ids = [], []
            for query, i, s in zip(b["query"], b.ids, b.scores):
                i, _ = _best(np.frombuffer(i, np.int64), np.frombuffer(s, np.float32), query, 2 * top)
                ids.append(np.append(i, query))
                q += [query] * (len(i) + 1)
            if q:
                yield pd.DataFrame({"q": q, "node": np.concatenate(ids)})

    pairs = found.mapInPandas(best, "q long, node long").distinct()
    pairs = pairs.join(nodes.select("node", "x", F.col("cls").alias("found")), "node").join(nodes.select(F.col("node").alias("q"), F.col("x").alias("qx"), "cls"), "q")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.stack(b[c].to_numpy()).astype(np.float64) for c in ("x", "qx"))
                yield pd.DataFrame({"cls": b.cls, "found": b.found, "score": (x * y).sum(1)})

    scored = pairs.select("cls", "found", "x", "qx").mapInPandas(exact, "cls long, found long, score double")
    each = scored.join(members.select(F.col("cls").alias("found"), F.col("id").alias("vec_id")), "found")
    # one list a class of queries, long enough for a member to leave itself out
    listed = each.withColumn("nth", F.row_number().over(W.partitionBy("cls").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= top + 1)
    listed = listed.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    # queries of equal vectors are rows of one class: those of a class with over a thousandth of them are not dealt by it
    n = asked.groupBy("cls").agg(F.count("*").alias("n"))
    hot = n.where(F.col("n") * 1000 > asked.count()).select("cls")
    listed = settle(listed)
    listed_hot = F.broadcast(listed.join(F.broadcast(hot), "cls", "left_semi"))
    met = asked.join(listed_hot, "cls").unionByName(asked.join(F.broadcast(hot), "cls", "left_anti").join(listed, "cls"))
    out = met.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top).alias("near"))
    out = out.select("query_id", F.posexplode("near").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
