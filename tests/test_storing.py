"""Commits and resumed work, the stored index, table functions, grounding and reports."""

import os
import signal
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seshat.functions.registered import register
from seshat.operators import evaluation, fulltext, grounding, reports
from seshat.operators.index import TextIndex
from seshat.sources.commits import Commits, resumed

ROOT = str(Path(__file__).resolve().parent.parent)
ROWS = [(1, "a b c"), (2, "b b d"), (3, None), (4, ""), (5, "c d e f"), (None, "a"), (5, "c d e f")]


def worked(d):
    return d.select("id", F.explode(F.split("text", " ")).alias("word"))


def test_resumed_work_is_done_once(spark, tmp_path):
    docs, calls = spark.createDataFrame(ROWS, "id long, text string"), []

    def work(d):
        calls.append(1)
        if len(calls) == 2:
            raise InterruptedError
        return worked(d)

    with pytest.raises(InterruptedError):
        resumed(docs, "id", work, str(tmp_path / "out"), 4)
    # what a run has written without a commit is not there, and goes
    spark.range(5).select(F.lit(9).cast("long").alias("id"), F.lit("x").alias("word")).write.parquet(str(tmp_path / "out/rows/commit=orphan"))
    got = sorted(map(str, resumed(docs, "id", work, str(tmp_path / "out"), 4).collect()))
    assert got == sorted(map(str, worked(docs).collect())) and not (tmp_path / "out/rows/commit=orphan").exists()
    before = len(calls)
    more = docs.unionByName(spark.createDataFrame([(6, "g")], docs.schema))
    assert resumed(more, "id", work, str(tmp_path / "out"), 4).where("id = 6").count() == 1 and len(calls) == before + 1
    assert resumed(docs.limit(0), "id", worked, str(tmp_path / "none"), 4).count() == 0


KILLED = """
import sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from seshat.sources.commits import resumed
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.range(40).withColumnRenamed("id", "doc")
resumed(docs, "doc", lambda d: d.select("doc", F.udf(lambda x: (time.sleep(0.4), x * 2)[1], "long")("doc").alias("twice")), {path!r}, 8)
"""


def test_a_killed_run_is_taken_up(spark, tmp_path):
    path = tmp_path / "out"
    run = subprocess.Popen([sys.executable, "-c", KILLED.format(root=ROOT, path=str(path))], env=os.environ | {"PYTHONPATH": ROOT}, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    end = time.time() + 120
    while time.time() < end and run.poll() is None and len([p for p in path.glob("commits/*") if p.name[0] != "."]) < 2:
        time.sleep(0.1)
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    done = len(Commits(spark, str(path)).names())
    assert 2 <= done < 8
    docs = spark.range(40).withColumnRenamed("id", "doc")
    got = resumed(docs, "doc", lambda d: d.select("doc", (F.col("doc") * 2).alias("twice")), str(path), 8)
    assert sorted(map(tuple, got.collect())) == [(i, 2 * i) for i in range(40)] and len(Commits(spark, str(path)).names()) == 8


def test_index_follows_changes(spark, tmp_path):
    rows = [(1, "red fish blue fish"), (2, "one fish"), (3, "blue sky"), (4, None), (None, "fish"), (6, "")]
    queries = spark.createDataFrame([(1, "blue fish"), (2, "sky none"), (3, "")], "query_id long, query string")
    index = TextIndex(spark, str(tmp_path / "index"), 4)
    ranked = lambda p: sorted(map(tuple, fulltext.bm25(p, 5).select("query_id", "id", "score", "rank").collect()))
    assert ranked(index.postings(queries)) == []
    index.upsert(spark.createDataFrame([(1, "old words"), (2, "one fish"), (7, "blue fish fish"), (3, "green")], "id long, content string"))
    index.upsert(spark.createDataFrame(rows, "id long, content string"))
    index.delete(spark.createDataFrame([(7,), (99,)], "id long"))
    now = spark.createDataFrame([r for r in rows if r[0] is not None and r[1] is not None], "id long, content string")
    want = ranked(fulltext.postings(queries, now))
    assert want and ranked(index.postings(queries)) == want
    assert {(r.term, r.df) for r in index.frequencies().where("term in ('fish', 'blue', 'old')").collect()} == {("fish", 2), ("blue", 2)}
    index.compact()
    assert len(index.store.names()) == 1 and ranked(index.postings(queries)) == want
    index.upsert(spark.createDataFrame([(3, "sky sky")], "id long, content string"))
    assert {r.id for r in fulltext.bm25(index.postings(queries), 5).where("query_id = 2").collect()} == {3}


def test_table_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "Title: T\nbody"), (2, "--- Page 2 ---\n a \n-- page 10 --\n \n--- Page 3 ---b"), (3, None), (4, " ")], "id long, t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, page, content FROM texts, LATERAL seshat_pages(t)").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "body"), (2, 2, "a"), (2, 3, "b")]
    # 3 is reached by 0.9 in two steps and by 0.5 in one: only the lower score leads on within two steps
    walks = [("x", None, 1, 1.0), ("x", 1, 2, 0.9), ("x", 2, 3, 1.0), ("x", 1, 3, 0.5), ("x", 3, 4, 1.0), ("y", None, 7, 2.0), ("y", 8, 9, 1.0)]
    spark.createDataFrame(walks, "part string, src long, dst long, score double").createOrReplaceTempView("walks")
    got = spark.sql("SELECT * FROM seshat_graph_search(TABLE(walks) PARTITION BY part ORDER BY (src, dst), 2, 3)").collect()
    assert sorted(map(tuple, got)) == [("x", 1, 0, 1.0), ("x", 2, 1, 0.9), ("x", 3, 2, 0.9), ("y", 7, 0, 2.0)]


def test_grounding_reasons(spark):
    cite = "[[A_2020, Page 1, Chunk 2]]"
    rows = [
        (1, f"@@ANSWER: 5 {cite}", "extract", "insufficient", 0, None), (2, "", "extract", "", 0, "empty final answer"), (3, "5", "extract", "", 0, "missing @@ANSWER prefix"), (4, "@@ANSWER: a @@answer: b", "extract", "", 0, "multiple @@ANSWER prefixes"),
        (5, "@@ANSWER: insufficient evidence", "extract", "insufficient", 1, None), (6, "@@ANSWER: insufficient evidence", "extract", "insufficient", 0, "insufficient evidence despite no missing slots"), (7, f"@@ANSWER: maybe {cite}", "boolean", "", 0, "boolean answer must start with yes/no"),
        (8, "@@ANSWER: 0", "compute", "zero_if_not_explicit", 1, None), (9, "@@ANSWER: 5", "extract", "", 0, "missing inline citations"), (10, f"@@ANSWER: 5 {cite}", "extract", "", 0, f"citation not present in context: {cite.lower()}"),
        (11, f"@@ANSWER: 5 {cite}", "compute", "", 0, None), (12, f"@@ANSWER: 5 {cite}", "compute", "", 0, "missing citation coverage for slot: s"), (13, None, None, None, None, "empty final answer"),
    ]
    a = spark.createDataFrame([r[:5] for r in rows], "query_id long, answer string, answer_type string, policy string, n_missing int")
    other = "[[B_2020, Page 1, Chunk 1]]"
    context = spark.createDataFrame([(1, cite.upper()), (10, other), (11, other), (12, cite)], "query_id long, citation string")
    ledger = spark.createDataFrame([(11, "s", cite), (12, "s", other), (12, "t", cite)], "query_id long, slot_key string, citation string")
    required = spark.createDataFrame([(11, "s"), (12, "s"), (12, "u")], "query_id long, slot_key string")
    assert {r.query_id: r.reason for r in grounding.grounded(a, context, ledger, required).collect()} == {r[0]: r[5] for r in rows}


def test_bootstrap_by_counts(spark):
    rng = np.random.default_rng(1)
    d = rng.choice([-1.0, 0.0, 0.5, 1.0], 400)
    pairs = spark.createDataFrame([(i, 0.0, float(x)) for i, x in enumerate(d)] + [(999, None, 1.0)], "k long, a double, b double")
    got, exact = reports.bootstrap_by_counts(pairs).first(), evaluation.bootstrap_interval(pairs.where("a is not null"), "k").first()
    assert got.mean_difference == pytest.approx(d.mean()) and abs(got.low - exact.low) < 0.01 and abs(got.high - exact.high) < 0.01
    many = spark.range(20_000).select(F.col("id").alias("k"), F.lit(0.0).alias("a"), F.sin(F.col("id").cast("double")).alias("b"))
    wide = reports.bootstrap_by_counts(many, 2000).first()  # several groups of differences
    x = np.sin(np.arange(20_000))
    half = 1.96 * x.std() / np.sqrt(len(x))
    assert abs(wide.low - (x.mean() - half)) < 0.1 * half and abs(wide.high - (x.mean() + half)) < 0.1 * half
    assert tuple(reports.bootstrap_by_counts(pairs.limit(0)).first()) == (0.0, 0.0, 0.0)


def test_reports(spark):
    a = spark.createDataFrame([("q1", 1.0, 0.0), ("q2", 1.0, None), ("q3", 0.0, 1.0), (" ", 1.0, 1.0), (None, 1.0, 1.0)], "query string, llm_judge_score double, hallucination double")
    b = spark.createDataFrame([(" q1", 0.0, 1.0), ("q2", 1.0, 0.0), ("q4", 1.0, 0.0)], "query string, llm_judge_score double, hallucination double")
    text = reports.paired_report("one", "two", a, b, ["llm_judge_score", "hallucination"], resamples=200).split("\n")
    assert text[0] == "=== one  vs  two    n=2 paired ===" and text[3].split()[0:4] == ["llm_judge_score", "1.0000", "0.5000", "+0.5000"] and text[3].split()[-3:] == ["1", "0", "1"]
    assert text[4].split()[-3:] == ["1", "0", "0"] and text[-1] == "McNemar (judge>=0.5): A_only_correct=1, B_only_correct=0, two-sided p=1"
    assert reports.paired_report("one", "two", a, b.limit(0), ["hallucination"]).endswith("(no overlapping queries)")
    none = spark.createDataFrame([], "query_id long, answer string, error string, hallucination double, llm_judge_score double")
    traces = spark.createDataFrame([(1, "reflection", None)], "query_id long, step string, attempts int")
    assert set(reports.run_diagnostics(none, traces).first().asDict().values()) == {0}
