"""Every operator on nulls, empty and very long texts, repeated rows, and columns that bear names of its own."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seshat.llm import chat_hmm, lm_scoring, minhash_dedup, mixing, nn_descent, secret_forest, token_counts, toxicity, warc_fixity
from seshat.llm.decontaminate import contaminated, without_contaminated

LONG = " ".join(f"w{i % 977}" for i in range(60_000)) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" the last five words here'
ROWS = [(1, LONG), (2, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "a b c d e f g h"), (6, "a b c d e f g h"), (None, "a b c d e f g h"), (None, None), (7, LONG + " end")]
CLASHING = "key score label at value secret item h n w block low shard place pass words draws size taken source_no row known alone rare part id x features held_out predicted counts ends cls sig keep found".split()


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("source", F.when(F.col("doc_id") != 5, F.lit("s")))
    for c in CLASHING:
        d = d.withColumn(c, F.lit(f"{c}!"))
    return d.cache()


def test_mixing(docs):
    got = mixing.mixture(mixing.sizes(docs)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert max(r.size for r in got) == 60_009 and {r.key for r in got} == {"key!"}


def test_lm_scoring(docs):
    got = lm_scoring.scored(docs).collect()
    assert len(got) == len(ROWS) and max(r.n_words for r in got) == 60_009
    same = [r.log_likelihood for r in got if r.n_words == 8]
    assert len(same) == 3 and max(same) - min(same) < 1e-4 and all((r.mean_log_probability is None) == (r.n_words == 0) for r in got)


def test_secrets(docs):
    found = secret_forest.scan(docs, ["doc_id", "n", "x"]).where("secret").collect()
    assert {(r.doc_id, r["at"], r.n) for r in found} == {(1, 60_002, "n!"), (7, 60_002, "n!")}
    clean = secret_forest.redacted(docs)
    assert clean.columns == docs.columns and clean.where("text like '%[SECRET]\" the last%' and key = 'key!'").count() == 2


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "The LAST five words here", "i"), (1, "the last five words here", "i"), (2, None, "i"), (3, "c d e", "i"), (None, "one", "i")], "item_id long, text string, item string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    assert got == {(1, 1), (7, 1), (6, 3), (None, 3)}
    left = without_contaminated(docs, items.where("item_id = 1"))
    assert left.columns == docs.columns and left.count() == len(ROWS) - 2


def test_near_duplicates(docs):
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 7)} == {(1, 1), (7, 1)}
    left = minhash_dedup.deduplicated(docs)
    # the rows without words stay once for each id and text
    assert left.columns == docs.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == ["1", "2", "3", "4", "5", "6", "None"]


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0, "l"), (6, 1, "l"), (6, 0, "l"), (None, 1, "l"), (5, None, "l")], "doc_id long, toxic int, label string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)


def test_token_counts(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_counts.token_counts(docs, path).collect()
    assert len(got) == len(ROWS) and {r.over_limit for r in got if r.doc_id in (1, 7)} == {True}
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {0}
    tables = token_counts.prefix_tables(docs, path)
    assert tables.where("size(counts) = length(text) + 1").count() == 8 and tables.where("counts is null").count() == 2


def test_fixity(spark):
    rows = [(1, "u", LONG), (1, "u", LONG), (2, None, None), (3, "", ""), (None, "u", "x"), (4, "v", "text"), (5, "w", "tttt")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("digest", "archive", "record_offset", "status", "leaf", "node", "level"):
        pages = pages.withColumn(c, F.lit("!"))
    own = warc_fixity.records(pages)
    assert own.count() == len(rows) and warc_fixity.audit(own, warc_fixity.records(pages)).count() == 0
    # a repeated record is lost once, one is changed, and one is extra
    other = spark.createDataFrame([rows[0], *rows[2:6], (5, "w", "7777"), (9, "n", "new")], "page_id long, url string, html string")
    found = {(r.page_id, r.status) for r in warc_fixity.audit(own, warc_fixity.records(other)).collect() if r.status != "moved"}
    assert {(1, "missing"), (5, "changed"), (9, "extra")} <= found
    assert warc_fixity.audit(own.limit(0), own.limit(0)).count() == 0


def test_neighbours(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [1.0]), (None, [1.0, 1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("cls", "id", "x", "node", "query_id", "rank", "score", "band"):
        e = e.withColumn(c, F.lit("!"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nn_descent.neighbours(e).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 0.5), (0, 3): (20, 0.0), (20, 1): (2, 0.5), (20, 2): (0, 0.0), (20, 3): (1, 0.0)}
    assert nn_descent.neighbours(e.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", LONG), (1, None, None, None), (2, 0, "tool", ""), (None, 0, "user", "x"), (3, 0, "user", "line\n" * 30_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("segment", "lines", "state", "first", "run", "key", "place"):
        turns = turns.withColumn(c, F.lit("!"))
    raw = chat_hmm.as_transcripts(turns)
    got = chat_hmm.parse(raw, chat_hmm.fit(raw)).collect()
    assert {r.conv_id for r in got} == {1, 2, 3} and {r.role for r in got} <= {"system", "user", "assistant"}
    # every line of every turn comes out once
    assert sum(r.n_lines for r in got if r.conv_id == 3) >= 30_000 and all(r.rendered.startswith("<|") and r.rendered.endswith("<|end|>") for r in got)
    assert chat_hmm.parse(raw.limit(0), chat_hmm.fit(raw.limit(0))).count() == 0
