"""Slots, acceptance, searches and checks on cases of their own."""

import pytest
from pyspark.sql import functions as F

from seshat.functions import numbers as N
from seshat.operators import checks as K
from seshat.operators import fulltext, ordering
from seshat.operators import retrieval as R
from seshat.operators import slots as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("query", "want"), [
    ("What did Best Buy and Johnson Controls say in Q2?", ["Best Buy and Johnson Controls", "Q2"]),
    ("Best Buy Co and Johnson Controls", ["Best Buy Co", "Johnson Controls"]),
    ("Which is AMD, or AMD?", ["AMD"]),
    ("", []),
    (None, []),
])
def test_named_entities(spark, query, want):
    got = one(spark, S.named_entities(F.lit(query)))
    # a phrase joined by "and" is two names only where both sides have two words or more
    assert got == (["Best Buy", "Johnson Controls", "Q2"] if want[:1] == ["Best Buy and Johnson Controls"] else want)


@pytest.mark.parametrize(("a", "b", "want"), [("Capex FY2018", "capital expenditures", True), ("revenue", "net sales", True), ("EBITDA", "debt", False), ("", "debt", False), (None, None, False), ("total assets", "assets", True)])
def test_metric_matches(spark, a, b, want):
    assert one(spark, S.metric_matches(F.lit(a), F.lit(b))) is want


@pytest.mark.parametrize(("value", "period", "title", "span", "want"), [
    ("5", "FY2019", "X_10K", "three months ended 2019: 5", False),
    ("5", "FY2019", "X_10K", "twelve months ended 2019: 5", True),
    ("77", "FY2019", "X_10K", "in 2019 it was 5", False),
    ("5", "FY2019", "X_2018_10K", "5", False),
    ("5", "", "X", "three months ended", True),
    ("5", "FY2019", "X", None, True),
])
def test_value_matches_period(spark, value, period, title, span, want):
    assert one(spark, S.value_matches_period(F.lit(value), F.lit(period), F.lit(title), F.lit(span))) is want


def test_ledger_matches_use_an_entry_once(spark):
    assert one(spark, S.ledger_matches(F.lit("100 - 100"), F.array(F.lit("100"), F.lit("x")))) == 1
    assert one(spark, S.ledger_matches(F.lit("100 / 50"), F.array(F.lit("$100"), F.lit("50.004")))) == 2
    assert one(spark, S.ledger_matches(F.lit(""), F.array(F.lit("1")))) == 0


@pytest.mark.parametrize(("value", "want"), [("1577", "num:1577"), ("0.5", "num:0.5"), ("2.5 billion", "num:2500000000"), ("n/a  Now", "txt:n/a now"), ("", ""), ("1,234,567,890,123", "num:1.23456789012e+12"), ("0.00001", "num:1e-05"), ("0", "num:0")])
def test_conflict_keys_have_twelve_digits(spark, value, want):
    assert one(spark, N.conflict_key(F.lit(value))) == want


def test_calculator(spark):
    rows = [("($1,000 + 1) * 2", 1), ("1 / 3", None), ("2 ** 70", None), ("", 2), (None, None), ("1 ** 100", 12)]
    d = spark.createDataFrame(rows, "e string, p int").select("e", S.calculated("e", "p").alias("c"))
    got = {r.e: (r.c.result, r.c.error) for r in d.collect()}
    assert got["($1,000 + 1) * 2"] == ("2002.0", None) and got["1 / 3"] == ("0.333333333333", None) and got["1 ** 100"] == ("1.00000000", None)
    assert got["2 ** 70"][0] is None and got[""][1] == got[None][1] == "empty expression"


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_places_without_a_window_over_the_group(spark, span):
    rows = [("a", i * 2 - 5) for i in range(9)] + [("b", 7), (None, 1), (None, 4), ("a", None)]
    d = spark.createDataFrame(rows, "g string, k long")
    got = {(r.g, r.k): r.place for r in ordering.ranked(d, ["g"], "k", span=span).collect()}
    want = {}
    for g in ("a", "b", None):
        for n, k in enumerate(sorted((k for h, k in rows if h == g), key=lambda k: (k is not None, k))):
            want[g, k] = n + 1
    assert got == want
    after = {r.k: r.next_k for r in ordering.ahead(d.where("g = 'a' and k is not null"), "g", "k", ["k"], 2, span).collect()}
    assert after == {i * 2 - 5: (i * 2 - 1 if i < 7 else None) for i in range(9)}


def test_postings_of_shuffled_terms_equal_sent_ones(spark):
    q = spark.createDataFrame([(1, "red fox"), (2, "blue"), (3, "")], "query_id long, query string")
    d = spark.createDataFrame([(1, "A red red fox."), (2, "blue fox"), (3, ""), (4, None), (5, "nothing")], "id long, content string")
    got = [sorted(map(tuple, fulltext.bm25(fulltext.postings(q, d, most=m), 5).collect())) for m in (0, 100)]
    assert got[0] == got[1] and {(r[0], r[1]) for r in got[0]} == {(1, 1), (1, 2), (2, 2)}


def test_two_stage_expands_only_unsure_queries(spark):
    lists = {n: spark.createDataFrame(rows, "query_id long, id long, rank int") for n, rows in {"minus": [(1, 1, 1), (1, 2, 2), (2, 5, 1)], "body": [(1, 2, 1)], "plus": [(1, 9, 1), (2, 6, 1)]}.items()}
    judge = lambda d: d.select("*", F.when(F.col("id").isin(1, 6), 0.9).otherwise(0.1).alias("rerank"), F.lit(0.0).alias("meta_boost"), F.lit(0.0).alias("boilerplate_penalty"), (F.col("id") != 2).alias("match"))
    got = {(r.query_id, r.id): (r.place, r.gated, r.expanded) for r in R.two_stage_retrieve(lists["minus"], lists["body"], lists["plus"], judge, 1).collect()}
    # the first query has its one row at the threshold; the second has none and finds it among the Q+ rows
    assert got == {(1, 1): (1, True, False), (2, 6): (1, True, True)}


def test_output_unwrapping(spark):
    assert one(spark, K.without_thoughts(F.lit("<think>a</think>b</think> c <end>"))) == "c"
    deep = '{"response": "{\\"answer\\": \\"{\\\\\\"result\\\\\\": \\\\\\"x\\\\\\"}\\"}"}'
    rows = [(deep, "x"), ('{"other": 1}', '{"other": 1}'), ("plain", "plain"), ('{"answer": 5}', '{"answer": 5}'), (None, None), ("{broken", "{broken")]
    d = spark.createDataFrame(rows, "m string, want string").select("want", K.unwrapped("m").alias("got"))
    assert all(r.got == r.want for r in d.collect())


def test_safe_casts_and_titles(spark):
    assert one(spark, K.safe(F.lit("7.9"), "int", 0)) == 7 and one(spark, K.safe(F.lit(None).cast("string"), "double", 2.5)) == 2.5
    assert one(spark, K.safe(F.lit("maybe"), "boolean", False)) is False
    assert one(spark, K.title_forms(F.lit("A_B (C)"))) == ["a_b (c)", "a b (c)", "a b c"] and one(spark, K.title_forms(F.lit(None).cast("string"))) == []


def test_broken_json_lines_are_not_lost(spark, tmp_path):
    from seshat.sources import tables

    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{broken\n{"k": 2}\n')
    assert tables.json_lines(spark, f"{tmp_path}/a.jsonl", "k long").count() == 2
    assert [r.line for r in tables.broken_lines(spark, f"{tmp_path}/a.jsonl").collect()] == ["{broken"]
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        tables.json_lines(spark, f"{tmp_path}/a.jsonl", "k long", strict=True).collect()


def test_the_last_writer_wins(spark):
    from seshat.sources import tables

    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, t long")
    new = spark.createDataFrame([(2, "z", 1), (2, "c", 3), (2, "y", 2), (3, None, 1)], "id long, v string, t long")
    got = sorted((r.id, r.v) for r in tables.upserted(old, new, "id", "t").collect())
    assert got == [(1, "a"), (2, "c"), (3, None)]
