"""Stored tables as queries: resumed work and the text index, each made in the shared folder from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seshat.functions import stems as ST
from seshat.functions import text as T
from seshat.functions.registered import register
from seshat.operators import fulltext
from seshat.operators.graph import next_edges
from seshat.operators.index import TextIndex
from seshat.plans.answering import sql_list
from seshat.plans.queries import BM25_SQL, SENTENCES, query, table
from seshat.sources.commits import Commits, resumed, shared_dir


def new_folder(spark) -> str:
    """A folder in the shared one that goes when the application ends."""
    path = f"{shared_dir(spark)}/seshat-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@query(f"SELECT doc_id, i - 1 AS nth, md5(s[i]) AS sentence_md5 FROM (SELECT doc_id, {SENTENCES} AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)")
def resumed_sentences(spark, sf):
    """Sentences of all documents, by a run that is stopped in its third batch and one that takes it up."""
    docs, path, seen = table(spark, sf, "documents"), new_folder(spark), []

    def work(d: DataFrame) -> DataFrame:
        seen.append(1)
        if len(seen) == 3:
            raise InterruptedError
        return d.select("doc_id", F.posexplode(T.sentences("text")).alias("nth", "s")).select("doc_id", F.col("nth").cast("long").alias("nth"), F.md5("s").alias("sentence_md5"))

    try:
        resumed(docs, "doc_id", work, path, 4)
    except InterruptedError:
        pass
    return resumed(docs, "doc_id", work, path, 4)


def stored_index(spark, sf) -> TextIndex:
    """An index of the documents, made from earlier versions of some and rows that are deleted again."""
    docs, index = table(spark, sf, "documents"), TextIndex(spark, new_folder(spark))
    old = docs.select("doc_id", F.when(F.col("lang") == "en", F.left("text", F.lit(200))).otherwise(F.col("text")).alias("text"))
    gone = docs.where("lang = 'de'").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    index.upsert(old.unionByName(gone), "doc_id", "text")
    index.upsert(docs.where("lang = 'en'"), "doc_id", "text")
    index.delete(gone, "doc_id")
    return index


@query(f"WITH {BM25_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM bm25")
def bm25_stored(spark, sf):
    found = fulltext.bm25(stored_index(spark, sf).postings(table(spark, sf, "benchmark"), "item_id", "text"), 10)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query("SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents) GROUP BY term")
def term_frequencies(spark, sf):
    index = stored_index(spark, sf)
    index.compact()
    return index.frequencies()


# --- table functions -----------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT conv_id, string_agg('--- Page ' || (turn + 1) || ' ---' || chr(10) || ' ' || text || ' ', chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content_md5 FROM conversations WHERE length(trim(text)) > 0""")
def page_table_function(spark, sf):
    register(spark)
    one = F.concat(F.lit("--- Page "), (F.col("turn") + 1).cast("string"), F.lit(" ---\n "), "text", F.lit(" "))
    c = table(spark, sf, "conversations").select("conv_id", F.struct("turn", one.alias("t")).alias("p"))
    c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "\n").alias("text")).createOrReplaceTempView("seshat_transcripts")
    return spark.sql("SELECT conv_id, page, md5(content) AS content_md5 FROM seshat_transcripts, LATERAL seshat_pages(text)")


@query("""WITH d AS (SELECT source, doc_id, CASE WHEN n_chars > 4000 THEN CAST(n_chars AS DOUBLE) END AS s FROM documents WHERE source IS NOT NULL),
e AS (SELECT source, doc_id, s, lag(s, 1) OVER w AS s1, lag(s, 2) OVER w AS s2 FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
b AS (SELECT source, doc_id, greatest(s, s1 * 0.5, s2 * 0.25) AS score, CASE WHEN s = greatest(s, s1 * 0.5, s2 * 0.25) THEN 0 WHEN s1 * 0.5 = greatest(s, s1 * 0.5, s2 * 0.25) THEN 1 ELSE 2 END AS hop FROM e WHERE s IS NOT NULL OR s1 IS NOT NULL OR s2 IS NOT NULL)
SELECT source AS part, doc_id AS node, CAST(hop AS INTEGER) AS hop, score FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, hop, doc_id) <= 20""")
def graph_table_function(spark, sf):
    """Long documents and what follows them within two steps in their source, by a table function over the edges of each."""
    register(spark)
    d = table(spark, sf, "documents").where("source is not null")
    edges = next_edges(d, "source", "doc_id", "doc_id").join(d.select(F.col("doc_id").alias("src"), "source"), "src").select(F.col("source").alias("part"), "src", "dst", F.lit(0.5).alias("score"))
    seeds = d.where("n_chars > 4000").select(F.col("source").alias("part"), F.lit(None).cast("long").alias("src"), F.col("doc_id").alias("dst"), F.col("n_chars").cast("double").alias("score"))
    edges.unionByName(seeds).createOrReplaceTempView("seshat_walks")
    return spark.sql("SELECT * FROM seshat_graph_search(TABLE(seshat_walks) PARTITION BY part ORDER BY (src, dst), 2, 20)")


# --- English terms -------------------------------------------------------------------------------------------------


def _cases(pairs, then: str, other: str) -> str:
    """CASE over endings, the longest first; {0} is the ending, {1} its length, {2} what takes its place."""
    rows = sorted(pairs.items(), key=lambda x: -len(x[0]))
    return "CASE " + " ".join(f"WHEN w LIKE '%_{e}' THEN " + then.format(e, len(e), new) for e, new in rows) + f" ELSE {other} END"


ENGLISH_SQL = f"""docs AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+(?:[''’][a-z]+)?'), lambda w: regexp_replace(w, '[''’]s?$', '')), lambda w: length(w) > 0 AND NOT list_contains({sql_list(ST.STOPWORDS)}, w)) AS words FROM documents WHERE text IS NOT NULL),
vocabulary AS (SELECT DISTINCT unnest(words) AS term FROM (SELECT words FROM docs)),
fit AS (SELECT term, CASE WHEN term LIKE 'y%' THEN 'Y' || substr(term, 2) ELSE term END AS w FROM vocabulary WHERE length(term) > 2 AND regexp_matches(term, '^[a-z]+$')),
s1 AS (SELECT term, CASE WHEN regexp_matches(w, '(ss|i)es$') THEN w[:-3] WHEN regexp_matches(w, '[^s]s$') THEN w[:-2] ELSE w END AS w FROM fit),
s2 AS (SELECT term, CASE WHEN w LIKE '%_eed' THEN CASE WHEN regexp_matches(w[:-4], '{ST.SOME}') THEN w[:-2] ELSE w END WHEN w LIKE '%_ed' AND regexp_matches(w[:-3], '{ST.VOWEL}') THEN w[:-3] WHEN w LIKE '%_ing' AND regexp_matches(w[:-4], '{ST.VOWEL}') THEN w[:-4] ELSE w END AS w, w LIKE '%_eed' AS eed, w AS old FROM s1),
s3 AS (SELECT term, CASE WHEN eed OR w = old THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN length(w) > 1 AND w[-1:] = w[-2:-2] AND w[-1:] NOT IN ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z') THEN w[:-2] WHEN regexp_matches(w, '{ST.SHORT}') THEN w || 'e' ELSE w END AS w FROM s2),
s4 AS (SELECT term, CASE WHEN w LIKE '%_y' AND regexp_matches(w[:-2], '{ST.VOWEL}') THEN w[:-2] || 'i' ELSE w END AS w FROM s3),
s5 AS (SELECT term, {_cases(ST.SECOND, "CASE WHEN regexp_matches(left(w, length(w) - {1}), '" + ST.SOME + "') THEN left(w, length(w) - {1}) || '{2}' ELSE w END", "w")} AS w FROM s4),
s6 AS (SELECT term, {_cases(ST.THIRD, "CASE WHEN regexp_matches(left(w, length(w) - {1}), '" + ST.SOME + "') THEN left(w, length(w) - {1}) || '{2}' ELSE w END", "w")} AS w FROM s5),
s7 AS (SELECT term, {_cases(dict.fromkeys(ST.FOURTH, ""), "CASE WHEN regexp_matches(left(w, length(w) - {1}), '" + ST.TWO + "') THEN left(w, length(w) - {1}) ELSE w END", f"CASE WHEN regexp_matches(w, '[st]ion$') AND regexp_matches(left(w, length(w) - 3), '{ST.TWO}') THEN left(w, length(w) - 3) ELSE w END")} AS w FROM s6),
s8 AS (SELECT term, CASE WHEN w LIKE '%_e' AND (regexp_matches(w[:-2], '{ST.TWO}') OR (regexp_matches(w[:-2], '{ST.ONE}') AND NOT regexp_matches(w[:-2], '{ST.SHORT}'))) THEN w[:-2] ELSE w END AS w FROM s7),
s9 AS (SELECT term, lower(CASE WHEN w LIKE '%_ll' AND regexp_matches(w[:-2], '{ST.TWO}') THEN w[:-2] ELSE w END) AS w FROM s8),
stems AS (SELECT v.term, coalesce(w, v.term) AS stem FROM vocabulary v LEFT JOIN s9 USING (term))"""


@query(f"WITH {ENGLISH_SQL} SELECT stem, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(words) AS term FROM docs) JOIN stems USING (term) GROUP BY stem")
def english_terms(spark, sf):
    t = table(spark, sf, "documents").where("text is not null").select(F.explode(ST.english("text")).alias("stem"))
    return t.groupBy("stem").agg(F.count("*").alias("n"))
