"""Draws of a bootstrap, against hashlib and the path of large tables."""

import hashlib

import numpy as np

from seshat.operators import evaluation
from seshat.operators.draws import drawn


def test_draws_are_those_of_md5():
    for n in (1, 10, 11, 1234, 20_001):
        got = {}
        for r, x in drawn(13, [0, 7, 12, 345, 9999], n):
            got.setdefault(r, []).extend(x.tolist())
        assert got == {r: [int(hashlib.md5(f"13-{r}-{i}".encode()).hexdigest()[:8], 16) for i in range(n)] for r in (0, 7, 12, 345, 9999)}
    assert next(drawn(13, [1], 5))[1].dtype == np.uint32


def test_both_ways_of_drawing_agree(spark, monkeypatch):
    rows = [(i, None if i % 11 == 0 else float(i % 3), float(i % 5) / 4) for i in range(300)]
    pairs = spark.createDataFrame(rows, "k long, a double, b double")
    sent = evaluation.bootstrap_interval(pairs, "k", 500)
    # differences go to the tasks that draw: no draw is a row
    assert "Range (0, 150000" not in sent._jdf.queryExecution().toString()
    got = sent.first()
    monkeypatch.setattr(evaluation, "MOST_LOOKED_UP", 299)
    joined = evaluation.bootstrap_interval(pairs, "k", 500)
    assert "Range (0, 150000" in joined._jdf.queryExecution().toString()
    assert got == joined.first() and None not in got
    assert evaluation.bootstrap_interval(pairs.where("k < 0"), "k", 5).first().low is None
