"""Queries on rows that the given tables have only at larger sizes, against their SQL."""

import datetime as dt

import duckdb

from seshat.plans import answering, covering, figures, storing  # noqa: F401  register their queries
from seshat.plans.queries import QUERIES, SQL


def check(spark, folder, name, **tables):
    """The rows of a query over these tables, which are those of its SQL."""
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t, (rows, columns) in tables.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.sql(SQL[name])
    rows = sorted((tuple(r) for r in got.select(*want.columns).collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)
    return rows


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def filings(customers):
    """An order of each year from 1996 to 1999 of each customer, a line of each flag and page."""
    orders, lines = [], []
    for k, c in enumerate(customers):
        for y in range(1996, 2000):
            o = 4 * k + y - 1995
            orders.append((o, c, "FOP"[y % 3], 10.0, dt.datetime(y, 5, 1), "1-URGENT"))
            lines += [(o, 10 + p, 3, p, 4.0, 100.0 + p, 0.0, 0.01, "RNN"[p % 3], "O", dt.datetime(1992, 6, 1)) for p in range(1, 5)]
    return {"orders": (orders, ORDERS), "lineitem": (lines, LINES)}


def test_entity_nodes_of_customers_whose_number_holds_the_year(spark, tmp_path):
    rows = check(spark, tmp_path, "filed_entity_nodes", **filings([5, 1996, 21996, 19960, 31997]))
    assert {q: len({t for c, _, t in rows if c == q}) for q in (5, 1996, 21996, 19960)} == {5: 1, 1996: 4, 21996: 4, 19960: 4}


def test_questions_of_customers_whose_number_is_the_year(spark, tmp_path):
    rows = check(spark, tmp_path, "filed_questions", **filings([5, 1998, 21998, 19980, 219980]))
    # by customer: nodes asked for figures
    assert {q: sum(r[2] for r in rows if r[0] == q) for q in (5, 1998, 21998, 19980, 219980)} == {5: 4, 1998: 16, 21998: 16, 19980: 16, 219980: 16}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_sentences_of_texts_without_any(spark, tmp_path):
    texts = [None, "", " \n", "One. Two!\tThree", "A.\x0bB", "A.\x0b B\x0b", "A\x01B. C", "A. \x85", "B. \u2028"]
    rows = check(spark, tmp_path, "sentence_split", documents=([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENTS))
    assert rows[:4] == [(0, None, None), (1, 0, None), (2, 0, None), (3, 3, 13)]


def test_values_told_apart_as_in_sql(spark, tmp_path):
    texts = {"a": [None, None], "b": ["", "  ", None], "c": ["X  y", "x y ", "x\x0by", "x "], "d": ["ΑΣ", "ας", "ασ"], "e": ["İ", "i"], None: ["x", ""]}
    rows = [(10 * k + i, t, "en", s, 0) for k, (s, every) in enumerate(texts.items()) for i, t in enumerate(every)]
    got = check(spark, tmp_path, "dedupe_values", documents=(rows, DOCUMENTS))
    assert {s: n for s, _, n in got} == {"a": 0, "b": 1, "c": 3, "d": 2, "e": 1, None: 2}
