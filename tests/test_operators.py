"""Operators on small fixtures: the cases the surveyed behaviour fixes, and invariants."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seshat.functions import numbers as N
from seshat.functions import periods as P
from seshat.functions import text as T
from seshat.operators import chunking as C
from seshat.operators import evidence as L
from seshat.operators import fusion, graph
from seshat.sources import tables as S
from seshat.streaming import events as stream


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "span", "want"), [("2.5 billion", "$2,500,000,000", True), ("(123)", "-123", True), ("77", "it was 5", False), ("", "x", False)])
def test_grounding(spark, value, span, want):
    assert one(spark, N.value_grounded("v", "s"), v=value, s=span) is want


@pytest.mark.parametrize(("text", "want"), [("3M posted $34,229 million in 2022", 34229.0), ("loss of (12.5) in 2020", -12.5), ("in 2021 it was 7", 7.0), ("only 2021", None)])
def test_primary_number(spark, text, want):
    assert one(spark, N.primary_number("t"), t=text) == want


@pytest.mark.parametrize(("expression", "want"), [("(1 + 2) * 3", 9.0), ("1 / 0", None), ("9 ** 9 ** 9", None), ("__import__('os')", None), ("-$1,000", -1000.0)])
def test_evaluate(expression, want):
    assert N.evaluate(expression) == want


@pytest.mark.parametrize(("a", "b", "want"), [("FY2022", "2021", False), ("", "2021", True), ("Q1 2022", "Q2 2022", False), ("Q1 2022", "FY2022", True)])
def test_periods_overlap(spark, a, b, want):
    assert one(spark, P.periods_overlap("a", "b"), a=a, b=b) is want


def test_company_keys(spark):
    assert "amazon" in one(spark, T.company_keys("q"), q="What is Amazon's revenue?")
    assert "amd" in one(spark, T.company_keys("q"), q="AMD margin in 2022")
    assert one(spark, T.company_keys("q"), q="") == []


def test_positive_amount(spark):
    assert one(spark, N.positive_amount("t"), t="was (1,200) then (3)") == "was 1,200 then (3)"
    assert one(spark, N.positive_amount("t"), t="was - 12") == "was 12"


def test_pages_of_marked_and_plain_documents(spark):
    docs = spark.createDataFrame([(1, "Document: A\n----- Page 1 -----\nfirst\n----- Page 2 -----\n\n--- page 3 ---\nthird"), (2, "Title: B\nbody"), (3, None)], "id long, text string")
    got = [(r.id, r.title, r.page, r.content) for r in C.pages(docs).orderBy("id", "page").collect()]
    assert got == [(1, "A", 1, "first"), (1, "A", 3, "third"), (2, "B", 1, "body")]


def test_table_sentences_and_broken_headers(spark):
    table = "| Year | Event |\n| 1999 | start |\n| 2000 | - |"
    assert one(spark, C.table_sentences(F.col("t")), t=table) == ["Year: 1999, Event: start.", "Year: 2000."]
    assert one(spark, C.has_broken_header(F.col("t")), t="| a |\n| b | 1 | 2 | 3 |") is True
    assert one(spark, C.has_broken_header(F.col("t")), t="| a |\n| x | Q1 2022 | Q2 2022 | FY 2023 |") is False


def test_greedy_runs_need_two_sentences(spark):
    c = C.greedy_runs(F.lit(5), F.col("s"), F.lit(0.5))
    assert one(spark, c, s=[0.1, 0.1, 0.1, 0.9]) == [0, 0, 1, 1, 1]
    assert one(spark, C.greedy_runs(F.lit(1), F.col("s"), F.lit(0.5)), s=[0.1]) == [0]


def test_chunks_hold_every_sentence(spark):
    docs = spark.createDataFrame([(1, "One two. Two three! Four five? Six. Seven eight."), (2, ""), (3, None)], "doc_id long, text string")
    got = C.chunks(docs).orderBy("sent_id").collect()
    assert {r.doc_id for r in got} == {1}
    assert " ".join(r.content for r in got) == "One two. Two three! Four five? Six. Seven eight."


def test_page_groups_and_rolling_context(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, "a"), (1, 2, 0.2, "b"), (1, 3, None, "c"), (1, 4, None, "d")], "k int, o int, next double, s string")
    assert [r.page_group for r in C.page_groups(rows, ["k"], "o", "next").orderBy("o").collect()] == [0, 0, 1, 1]
    got = C.rolling_context(rows.withColumn("intro", F.lit("I")), ["k"], "o", "s", "intro").orderBy("o").collect()
    assert [r.context for r in got] == ["I", "I || Recent: a", "I || Key points: a || Recent: b", "I || Key points: a | b || Recent: c"]


def test_markdown_tables(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(["| a | b |", "| 1 | 2 |", "text", "| lone | row |"])], "k int, o int, line string")
    assert [(r.first_line, r.n_lines) for r in C.markdown_tables(rows, ["k"], "o", "line").collect()] == [(0, 2)]


def test_gate_gives_k_at_most(spark):
    rows = spark.createDataFrame([(1, f"n{i}", s, s) for i, s in enumerate([0.9, 0.8, 0.7, 0.1, 0.05])], "query_id int, id string, rerank double, final_score double")
    assert [r.id for r in fusion.gated(rows, 2).orderBy("place").collect()] == ["n0", "n1"]
    assert [r.id for r in fusion.gated(rows, 4).orderBy("place").collect()] == ["n0", "n1", "n2", "n3"]
    assert fusion.gated(rows, 1, least=3).count() == 3


def test_amd_before_amcor(spark):
    rows = spark.createDataFrame([(1, "a", "AMCOR_2022_10K", "x", 0.8), (1, "b", "AMD_2022_10K", "x", 0.8)], "query_id int, id string, title string, content string, rerank double")
    best = fusion.gated(fusion.calibrated(rows.withColumn("query", F.lit("What was AMD revenue in 2022?"))), 1).first()
    assert best.id == "b"


def test_traversal(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x")], "src string, dst string")
    scores = spark.createDataFrame([(1, n, s) for n, s in (("b", 0.8), ("c", 0.7), ("d", 0.6), ("x", 0.1))], "query_id int, id string, score double")
    seeds = spark.createDataFrame([(1, "a", 0.9)], "query_id int, id string, score double")
    got = graph.best_first(edges, seeds, scores, 5, 2, 0.4)
    assert [(r.id, r.hop) for r in got.orderBy("rank").collect()] == [("a", 0), ("b", 1), ("c", 2), ("x", 1)]


def test_slot_keys_and_tools(spark):
    s = spark.createDataFrame([((" 3M ", "FY2022", "Revenue", None, None, None),)], "slot struct<entity:string,period:string,metric:string,source_anchor:string,unit:string,rounding:string>")
    assert s.select(L.slot_key(F.col("slot")).alias("k")).first().k == "entity=3m|period=fy2022|metric=revenue"
    calls = spark.createDataFrame([(1, '<tool_call>{"name": "calculator", "arguments": "1+1"}</tool_call> <tool_call>{bad}</tool_call>')], "n int, r string")
    assert [(r.name, r.arguments) for r in L.tool_calls(calls, ["n"], "r").collect()] == [("calculator", "1+1")]
    assert one(spark, L.routed_tool("t"), t="retrieve") == "graph_search"
    assert one(spark, L.boolean_label("t"), t="@@ANSWER: Yes [[A, Page 1, Chunk 2]]") == "yes"
    assert one(spark, L.prefixed("t"), t="5") == "@@ANSWER: 5"


def test_period_nodes_fail_open_on_the_period_alone(spark):
    n = spark.createDataFrame([(1, "CVSHEALTH_2019_10K", True, False)], "query_id int, title string, e boolean, p boolean")
    assert L.period_nodes(n, F.col("e"), F.col("p"), False).count() == 0
    assert L.period_nodes(n, F.col("e"), F.col("p"), True).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a_page_1.txt").write_text("one\ntwo")
    (tmp_path / "b.md").write_text("x")
    (tmp_path / "c.pdf").write_text("no")
    files = S.text_files(spark, str(tmp_path))
    assert {r.name for r in files.collect()} == {"a_page_1.txt", "b.md"}
    assert [r.name for r in S.sampled_files(files, spark.createDataFrame([("a",)], "doc string")).collect()] == ["a_page_1.txt"]
    empty = S.parquet_or_empty(spark, str(tmp_path / "none"), spark.range(1).schema)
    assert empty.count() == 0 and empty.columns == ["id"]
    (tmp_path / "q.jsonl").write_text('{"id": 1}\n\nbroken\n{"id": 2}\n')
    assert S.json_lines(spark, str(tmp_path / "q.jsonl"), "id int").count() == 2
    plan = S.cleanup_plan(spark.createDataFrame([("HR_a",), ("HR_old",), ("z",)], "name string"), ["HR_a"], ["HR_"])
    assert {(r.name, r.action) for r in plan.collect()} == {("HR_a", "keep"), ("HR_old", "drop"), ("z", "ignore")}


def test_stream_agrees_with_batch(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    q = stream.windowed_means(stream.event_stream(spark, folder), late="1 minute").writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = stream.windowed_means(spark.read.parquet(f"{folder}/events.parquet")).withColumn("window_start", F.col("window_start").cast("timestamp"))
    assert spark.table("means").exceptAll(batch).count() == 0
    assert batch.exceptAll(spark.table("means")).count() == 0
