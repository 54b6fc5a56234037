"""Nearest rows by tiles, against brute force and SQL."""

import math
import random

import pytest

from seshat.operators.nearest import nearest
from seshat.operators.vectors import blocked_knn
from tests.test_rare_rows import check

VECTORS = "vec_id long, embedding array<float>, label int"


def dot(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


def cosine(a, b):
    d = dot(a, b)
    n = (dot(a, a) or 0.0) * (dot(b, b) or 0.0)
    return 0.0 if d is None or n == 0 else max(-1.0, min(1.0, d / math.sqrt(n)))


def table(n=60):
    """Copies, multiples, zeros, vectors of two lengths and without some components, in blocks of uneven size."""
    r = random.Random(3)
    some = [[r.choice([-1.0, 0.5, 1.0, 3.0]) for _ in range(5)] for _ in range(9)]
    rows = [(i, r.choice("aaab"), [x * r.choice([1.0, 3.0, 1e7]) for x in r.choice(some)]) for i in range(n)]
    return rows + [(n + i, "a", v) for i, v in enumerate([None, [0.0] * 5, [1.0, 2.0], [2.0, 4.0], [1.0, None, 1.0, 1.0, 1.0], []])] + [(n + 9, None, [1.0] * 5)]


@pytest.mark.parametrize("tile", [7, 1000])
@pytest.mark.parametrize("by_cosine", [True, False])
def test_nearest_is_that_of_all_pairs(spark, tile, by_cosine):
    rows = table()
    score = cosine if by_cosine else dot
    df = spark.createDataFrame(rows, "id long, block string, v array<double>")
    got = {}
    for x in nearest(df.where("id % 2 = 1"), df, 4, by_cosine, tile=tile).orderBy("q", "rank").collect():
        got.setdefault(x.q, []).append((x.r, x.score))
    want = {}
    for q, b, v in rows:
        if q % 2 and b is not None:
            every = [(r, score(v, w)) for r, c, w in rows if c == b]
            want[q] = sorted(every, key=lambda x: (x[1] is None, -(x[1] or 0.0), x[0]))[:4]
    assert got == want


def test_neighbours_leave_out_the_row_itself(spark):
    rows = [(i, "a", [1.0, 1.0], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, block string, v array<float>, src long")
    got = blocked_knn(df, 3, "block", "id", "v").collect()
    assert sorted((r.src, r["rank"], r.dst) for r in got) == [(i, k + 1, d) for i in range(40) for k, d in enumerate([d for d in range(5) if d != i][:3])]
    apart = blocked_knn(df, 3, "block", "id", "v", other_than="src").collect()
    assert all(r.src % 2 != r.dst % 2 for r in apart) and {r.src for r in apart} == set(range(40))


@pytest.mark.parametrize("name", ["knn_join_blocked", "hop_edges", "cosine_topk", "question_edges", "unused_nodes", "abstract_edges"])
def test_equal_directions_are_ranked_as_in_sql(spark, tmp_path, name):
    """Multiples of a vector have one cosine, which rounding may tell apart: ranks are those of the SQL's arithmetic."""
    r = random.Random(8)
    some = [[r.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x * f for x in r.choice(some)], i % 3) for i, f in enumerate(r.choice([1.0, 0.3, 0.7, 11.0]) for _ in range(303))]
    assert check(spark, tmp_path, name, embeddings=(rows, VECTORS))
