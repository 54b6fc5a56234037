import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seshat.llm import components as cc
from seshat.llm import minhash_dedup as md
from seshat.llm.decontaminate import contaminated, needed, without_contaminated
from seshat.llm.nn_descent import bands, neighbours


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def expected_components(texts, n, percent):
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    low = {i: i for i in texts}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both and 100 * both >= percent * union:
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def corpus(seed=1, groups=12):
    rng, texts = random.Random(seed), {}
    for _ in range(groups):
        base = [rng.choice("alpha beta gamma delta rho tau phi chi".split()) + str(rng.randrange(60)) for _ in range(rng.randrange(6, 80))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
            texts[len(texts) * 3 + 1] = " ".join(w)
    return texts


@pytest.mark.parametrize(("n", "options"), [(2, {}), (5, {}), (2, {"block_docs": 2, "posting_rows": 2, "broadcast_rows": 0})])
def test_near_duplicates_equal_brute_force(spark, n, options):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, cls string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in md.near_duplicates(docs, shingle=n, **options).collect()}
    assert got == expected_components(texts, n, 80)


def test_near_duplicates_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "é É"), (None, "a b c"), (7, "a b c"), (7, "a b c"), (8, long), (9, long + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in md.near_duplicates(docs, shingle=2).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 2, 7, True), (7, 2, 7, True), (8, 29_999, 8, True), (9, 30_000, 8, False), (None, 2, None, True)]
    assert got == want
    assert md.near_duplicates(docs.limit(0)).count() == 0


def test_exact_links_across_blocks():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(12)]
    want = {(i, j) for i, j in itertools.combinations(range(12), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(*map(list, md.exact_links(sets, 50)))) == want
    assert set(zip(*map(list, md.exact_links(sets, 50, 5)))) == {(i, j) for i, j in want if i < 5 <= j}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.v: r.p for r in cc.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 130)}}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contaminated_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = {i: " ".join(rng.choices(words, k=rng.randrange(5, 40))) for i in range(12)} | {20: "Only three words", 21: "", 22: None}
    docs = {}
    for i in range(60):
        w = rng.choices(words, k=rng.randrange(30, 300))
        if i % 2:
            part = items[i % 12].split()
            cut = rng.randrange(0, max(1, len(part) // 3))
            w[10:10] = part[cut:]
        docs[i] = " ".join(w).title()
    docs[70], docs[71], docs[72] = "only THREE  words", None, " "
    docs[73], docs[74] = "here ONLY three Words stand", "only three other words"
    items[23] = "One"
    docs[75] = "not one, but One here"
    d = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, item string")
    t = spark.createDataFrame([(i, x) for i, x in items.items()], "item_id long, text string")
    runs = lambda x, b: shingle_set(x, min(5, len((items[b] or "").split()) or 1)) if len((x or "").split()) >= len((items[b] or "").split()) or len((items[b] or "").split()) >= 5 else set()
    sets = {i: shingle_set(x, 5) for i, x in items.items()}
    want = {(a, b): len(runs(x, b) & sets[b]) for a, x in docs.items() for b in items if sets[b] and 100 * len(runs(x, b) & sets[b]) >= 80 * len(sets[b])}
    assert (73, 20) in want and (74, 20) not in want and (75, 23) in want
    for options in ({}, {"broadcast_rows": 0}):
        assert {(r.doc_id, r.item_id): r.shared for r in contaminated(d, t, **options).collect()} == want
    left = {r.doc_id for r in without_contaminated(d, t).collect()}
    assert left == set(docs) - {a for a, _ in want}
    assert without_contaminated(d, t).columns == d.columns
    assert contaminated(d.limit(0), t).count() == 0 and contaminated(d, t.limit(0)).count() == 0


def test_needed_agreements():
    assert needed(14, 0.8) == 1
    assert needed(40, 0.8) > needed(20, 0.8)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 12)).astype(np.float32)
    x[300:420] = x[5]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [1.0, None] + [0.0] * 10), (1004, [1.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = {}
    for r in neighbours(df, beam=120).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y, hits = x.astype(np.float64), 0
    assert set(got) == set(range(0, 700, 20))
    for q, near in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        best = sorted(range(700), key=lambda i: (-s[i], i))[:20]
        assert len(near) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in near)
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in near} & set(best))
        if q in range(300, 420):
            assert [i for i, _ in near] == best
    assert hits >= 0.95 * 20 * len(got)


def test_neighbours_beside_long_and_short_vectors(spark):
    """Norms far apart are bands of their own: recall among the others stays as it is, and they are found too."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16))
    x = np.concatenate([x, [(x[0] + 0.3) * 1e5, (x[7] - 0.1) * 1e7], rng.standard_normal((30, 16)) * 1e-3, [x[3] * 1e200]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours(df, beam=120).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = sorted(range(len(x)), key=lambda i: (-s[i], i))[:20]
        near = sorted(got[q])
        assert len(near) == 20 and all(np.isclose(v, s[i], rtol=1e-12) for _, i, v in near)
        hits += len({i for _, i, _ in near} & set(best))
    assert hits >= 0.95 * 20 * len(got)


def test_bands():
    assert bands({5: 3, 4: 1, -11: 7, 300: 1, -12: 2}) == [(300, 1), (5, 4), (-11, 9)] and bands({}) == []


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id, r.score) for r in neighbours(df).orderBy("rank").collect()] == [(1, 2, 1.0), (2, 1, 0.0)]
    assert neighbours(df.limit(0)).count() == 0
