"""op11 to op13: against brute force, on disguises, and on nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seshat.llm import private_spans as P
from seshat.llm import queries
from seshat.llm.hard_negatives import PART, Index, Tree, hard_negatives
from seshat.llm.whitening import deviations, whitened

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(s):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, s):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1]))
            fits = {"email": True, "ip": all(int(x or 0) < 256 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and total % 10 == 0, "phone": 10 <= len(d) <= 15}
            if fits[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_plain_identifiers_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        s = "".join(rng.choice(["a", ".", "@", "-", "1", "25", "3", "+", " ", "(", "4111111111111111", "é", "b", "0"]) for _ in range(rng.randrange(40)))
        assert P.listed(P.plain(s)) == base(s), s


def test_documents_equal_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.op11_private_spans(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and (r.spans, r.n_added) == (want, 0)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in BASE]


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe at example dot com, please", "email", "john.doe at example dot com"),
        ("mail jоhn@exаmple.com now", "email", "jоhn@exаmple.com"),
        ("x a (at) b [dot] co {dot} uk x", "email", "a (at) b [dot] co {dot} uk"),
        ("see j.smith at example.com.", "email", "j.smith at example.com"),
        ("it is me&#64;here&#46;org ok", "email", "me&#64;here&#46;org"),
        ("to john@​example.com", "email", "john@​example.com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
        ("call plus 1 555 123 4567 today", "phone", "plus 1 555 123 4567"),
        ("pay four one one one one one one one one one one one one one one one now", "card", "four one one one one one one one one one one one one one one one"),
        ("card ４１１１ 1111 1111 1111.", "card", "４１１１ 1111 1111 1111"),
        ("at one nine two dot one six eight dot zero dot one here", "ip", "one nine two dot one six eight dot zero dot one"),
        ("at 192[.]168[.]0[.]1 here", "ip", "192[.]168[.]0[.]1"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    at = text.index(span)
    assert (at, at + len(span), kind) in P.disguised("é " * 3 + text) or (at + 6, at + 6 + len(span), kind) in P.disguised("é " * 3 + text)
    assert P.without(text) == text[:at] + f"[{kind.upper()}]" + text[at + len(span) :]


@pytest.mark.parametrize("text", ["look at example.com today", "5 apples @ 3.50 each", "+1 (848) 555-1373 Un an", "meet me at the dot com office", "one or two at home", "", "at dot at dot", "1 dot 2 dot 3", "naïve café № 5, x² + y²"])
def test_clean_texts_gain_nothing(text):
    assert P.disguised(text) == []


def test_private_spans_of_odd_rows(spark):
    long = "word " * 400_000 + "a@b.cd"
    rows = [(1, None), (1, ""), (None, "a@b.cd"), (2, "a@b.cd"), (2, "a@b.cd"), (3, long), (4, "1" * 300_000), (5, "j at b dot com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "'y' as n_email", "0 as base_sha256")
    got = {(r.doc_id, r.n_email, r.spans, r.n_added) for r in P.private_spans(docs).collect()}
    assert got == {(1, 0, "", 0), (None, 1, "email:0:6", 0), (2, 1, "email:0:6", 0), (3, 1, "email:2000000:2000006", 0), (4, 0, "", 0), (5, 0, "email:0:14", 1)}
    assert P.private_spans(docs).count() == len(rows) and P.private_spans(docs.limit(0)).count() == 0
    clean = P.masked(docs)
    assert clean.columns == docs.columns and {r.text for r in clean.where("doc_id in (1, 2, 5)").collect()} == {None, "", "[EMAIL]"}


def whitened_by_hand(embedding, most=8):
    x = np.floor(1024 * np.stack(embedding).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, w = np.linalg.eigh(y.T @ y / n)
    e, w = e[::-1], w[:, ::-1]
    return ((n * x - s) ** 2).sum(1), y @ w[:, :most] / np.sqrt(np.abs(e[:most])), e[:most] / e.sum()


def test_whitening_equals_the_whole_matrix(spark):
    p = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    got = queries.op12_whitening(spark, "/root/testdata/sf0.01").toPandas().sort_values(["vec_id", "component"])
    p = p.sort_values("vec_id")
    far, w, explained = whitened_by_hand(p.embedding)
    mine = got.whitened.to_numpy().reshape(len(p), 8)
    assert (got.deviation.to_numpy().reshape(len(p), 8) == far[:, None]).all() and (got.n == len(p)).all()
    assert abs(mine * np.sign((mine * w).sum(0)) - w).max() < 1e-8
    assert abs(got.explained.to_numpy()[:8] - explained).max() < 1e-12 and got.identity_error.max() < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 2.0]), (1, [0.5, 1.0, 2.0]), (None, [1.5, -1.0, 0.0]), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 0.0, 0.0]), (7, [1.0, 2.0]), (8, [-3.0, 0.25, 1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'a' as component", "'b' as n", "'c' as v", "'d' as id")
    got = whitened(e).orderBy("vec_id", "component").collect()
    kept = [r for r in rows if r[1] in ([0.5, 1.0, 2.0], [1.5, -1.0, 0.0], [-3.0, 0.25, 1.0])]
    far, _, explained = whitened_by_hand([r[1] for r in kept])
    assert len(got) == 4 * 3 and {r.n for r in got} == {4} and sorted({r.deviation for r in got}) == sorted(set(far.tolist()))
    live = [k for k, x in enumerate(explained) if x > 1e-12]
    assert all((r.whitened is not None) == (r.component - 1 in live) for r in got) and got[0].identity_error < 1e-9
    one = whitened(e.where("vec_id = 8")).collect()
    assert len(one) == 3 and all((r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, None, None) for r in one)
    assert whitened(e.limit(0)).count() == 0 and whitened(e.where("vec_id = 3")).count() == 0
    huge = spark.createDataFrame([(1, [3e38]), (2, [-3e38])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitened(huge).collect()} == {None}
    assert deviations(np.array([[1 << 40], [0]]), 2, [1 << 40], np.array([1 << 39])) == [None, None]


def negatives_by_hand(rows, every=100):
    out = []
    for a, label, x in rows:
        if a % every == 0:
            s = sorted(((-int(x @ y), i, m == label) for i, m, y in rows if i != a))
            for p in [r for r in s if r[2]][:5]:
                hard = [r for r in s if not r[2] and -80 * p[0] <= -100 * r[0] <= -100 * p[0]][:5]
                out += [(a, p[1], k + 1, r[1], -p[0], -r[0]) for k, r in enumerate(hard)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3 * PART, 8)) * rng.choice([0.2, 1, 3], (3 * PART, 1))
    x[100:2100] = x[100]  # one vector of a third of the rows
    label = rng.integers(0, 4, len(x))
    e = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "label": label, "embedding": x.tolist()}))
    rows = [(int(i), int(m), v) for i, m, v in zip(range(len(x)), label, np.floor(256 * x).astype(np.int64))]
    assert sorted(map(tuple, hard_negatives(e).collect())) == negatives_by_hand(rows)


def test_trees_give_rows_nearest_first():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (1000, 6))
    points = pd.DataFrame({"v": [v.astype("<i8").tobytes() for v in x], "n2": (x * x).sum(1), "label": rng.integers(0, 3, 1000), "cls": [bytes([k % 256, k // 256]) for k in range(1000)], "ids": [[k] for k in range(1000)]})
    index = Index(int(points.n2.max()), points, 0)
    tree = Tree(index, points)
    for q in x[:20]:
        s = x @ q
        low, high = int(0.5 * s.max()), int(0.9 * s.max())
        got = list(tree.nearest(index, q.astype(float), int(q @ q), 1, False, low, high))
        fits = np.flatnonzero((points.label != 1) & (s >= low) & (s <= high))
        assert [k for k, _ in got] == sorted(fits.tolist(), key=lambda k: (-s[k], k)) and all(s[k] == v for k, v in got)


def test_hard_negatives_sql(spark):
    for name in ("embeddings",):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{name}.parquet')")
    want = sorted(tuple(map(int, r)) for r in duckdb.sql(queries.OP13_SQL).fetchall())
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, "/root/testdata/sf0.01").collect())) == want and want


def test_hard_negatives_of_odd_rows(spark):
    nan = float("nan")
    rows = [
        (0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.0]), (3, 2, [0.9, 5.0]), (4, 2, [2.0, 0.0]), (5, None, [0.9, 0.0]), (None, 2, [0.9, 0.0]),
        (6, 2, None), (7, 2, [nan, 0.0]), (8, 2, [0.9, None]), (9, 2, [0.9]), (10, 2, []), (11, 2, [1e300, 0.0]), (100, 3, [0.0, 0.0]), (200, 3, [0.0, 0.0]), (300, 9, [1.0, 1.0]),
    ]
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("cls", F.lit("x")).withColumn("leaf", F.lit("y")).withColumn("high", F.lit(0))
    good = {(i, m, tuple(x)) for i, m, x in rows if i is not None and m is not None and x and len(x) == 2 and None not in x and not any(c != c for c in x) and max(x) < 1e9}
    want = negatives_by_hand([(i, m, np.floor(256 * np.array(x)).astype(np.int64)) for i, m, x in sorted(good)])
    assert sorted(map(tuple, hard_negatives(e).collect())) == want and len(want) > 10
    assert hard_negatives(e.limit(0)).count() == 0 and hard_negatives(e.where("vec_id = 300")).count() == 0
