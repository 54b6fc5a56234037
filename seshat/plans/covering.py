"""Further operators as queries over whole tables, each with SQL that applies its rule to the tables' own values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seshat.functions import periods as P
from seshat.functions import text as T
from seshat.operators import answers as A
from seshat.operators import chunking as C
from seshat.operators import evidence as L
from seshat.operators import fusion, grounding
from seshat.operators import retrieval as R
from seshat.operators import states as S_
from seshat.operators import vectors as V
from seshat.plans.answering import NODES_SQL, SIDE_SQL, _sides, filings, sql_list
from seshat.plans.queries import QEDGE_SQL, SENTENCES, query, table
from seshat.plans.queries import _questions as vector_questions
from seshat.plans.storing import new_folder
from seshat.sources import tables as S

CITE_SQL = "'[[C' || o_custkey || '_' || year(o_orderdate) || ', Page 1, Chunk ' || o_orderkey || ']]'"
GROUNDED_SQL = f"""WITH o AS (SELECT *, o_custkey AS query_id, lower({CITE_SQL}) AS k FROM orders),
a AS (SELECT query_id, CASE WHEN count(*) % 4 = 0 THEN 'compute' WHEN min(o_orderpriority) > '1' THEN 'boolean' ELSE 'extract' END AS answer_type, CASE WHEN max(o_totalprice) > 440000 THEN 'zero_if_not_explicit' WHEN max(o_totalprice) > 420000 THEN 'inapplicable_explain' ELSE 'insufficient' END AS policy,
    count(*) FILTER (o_totalprice < 30000) AS n_missing, CASE WHEN max(o_totalprice) < 250000 THEN '' WHEN max(o_totalprice) < 330000 THEN 'it is ' ELSE '@@ANSWER: ' END || CASE WHEN min(o_totalprice) < 6000 THEN 'insufficient evidence' WHEN min(o_totalprice) < 9000 THEN '0' WHEN min(o_orderstatus) = 'F' THEN 'Yes, so it is' ELSE 'It is so' END AS head,
    list(DISTINCT k) FILTER (o_totalprice > 300000) AS cites FROM o GROUP BY query_id),
c AS (SELECT DISTINCT query_id, k FROM o WHERE o_orderpriority < '4'), l AS (SELECT DISTINCT query_id, o_orderstatus AS slot_key, k FROM o WHERE o_totalprice > 200000),
w AS (SELECT query_id, min(x) AS outside FROM (SELECT query_id, answer_type, unnest(cites) AS x FROM a) WHERE x NOT IN (SELECT k FROM c) AND NOT (answer_type = 'compute' AND x IN (SELECT k FROM l)) AND query_id IN (SELECT query_id FROM c) GROUP BY query_id),
u AS (SELECT query_id, min(slot_key) AS uncovered FROM (SELECT l.query_id, l.slot_key, bool_or(list_contains(coalesce(cites, []), k)) AS hit FROM l JOIN a USING (query_id) GROUP BY ALL) WHERE NOT hit GROUP BY query_id),
j AS (SELECT a.*, outside, uncovered, head LIKE '%insufficient%' AS gave_up, head = '@@ANSWER: 0' AND policy = 'zero_if_not_explicit' AND n_missing > 0 AS zero FROM a LEFT JOIN w USING (query_id) LEFT JOIN u USING (query_id))
SELECT query_id, CASE WHEN NOT contains(head, '@@ANSWER:') THEN 'missing @@ANSWER prefix' WHEN gave_up AND n_missing > 0 AND policy = 'zero_if_not_explicit' THEN 'query policy requires zero when value is not explicitly outlined' WHEN gave_up AND n_missing > 0 AND policy = 'inapplicable_explain' THEN 'query policy requires inapplicable explanation, not insufficient evidence'
    WHEN gave_up AND n_missing = 0 THEN 'insufficient evidence despite no missing slots' WHEN NOT gave_up AND answer_type = 'boolean' AND NOT contains(head, 'Yes') THEN 'boolean answer must start with yes/no' WHEN gave_up OR zero THEN NULL WHEN cites IS NULL THEN 'missing inline citations'
    WHEN outside IS NOT NULL THEN 'citation not present in context: ' || outside WHEN answer_type = 'compute' AND uncovered IS NOT NULL THEN 'missing citation coverage for slot: ' || uncovered END AS reason FROM j"""


@query(GROUNDED_SQL)
def grounded_answers(spark, sf):
    o, price = table(spark, sf, "orders"), F.col("o_totalprice")
    cite = F.concat(F.lit("[[C"), "o_custkey", F.lit("_"), F.year("o_orderdate"), F.lit(", Page 1, Chunk "), "o_orderkey", F.lit("]]"))
    o = o.withColumn("query_id", F.col("o_custkey")).withColumn("citation", cite)
    low, high = F.min(price), F.max(price)
    head = F.concat(F.when(high < 250000, "").when(high < 330000, "it is ").otherwise("@@ANSWER: "), F.when(low < 6000, "insufficient evidence").when(low < 9000, "0").when(F.min("o_orderstatus") == "F", "Yes, so it is").otherwise("It is so"))
    a = o.groupBy("query_id").agg(
        F.when(F.count("*") % 4 == 0, "compute").when(F.min("o_orderpriority") > "1", "boolean").otherwise("extract").alias("answer_type"), F.when(high > 440000, "zero_if_not_explicit").when(high > 420000, "inapplicable_explain").otherwise("insufficient").alias("policy"),
        F.count_if(price < 30000).alias("n_missing"), head.alias("head"), F.array_sort(F.collect_set(F.when(price > 300000, F.col("citation")))).alias("cites"),
    )
    # an answer of zero by policy bears no citations
    a = a.withColumn("answer", F.concat_ws(" ", "head", F.when(~F.col("head").endswith("0"), F.array_join("cites", " "))))
    a = a.withColumn("answer", F.when(F.col("head").endswith("0") & ((F.col("policy") != "zero_if_not_explicit") | (F.col("n_missing") == 0)), F.concat_ws(" ", "head", F.array_join("cites", " "))).otherwise(F.col("answer")))
    required = o.select("query_id", F.col("o_orderstatus").alias("slot_key")).distinct()
    ledger = o.where(price > 200000).select("query_id", F.col("o_orderstatus").alias("slot_key"), "citation")
    return grounding.grounded(a.drop("head", "cites"), o.where("o_orderpriority < '4'").select("query_id", "citation"), ledger, required).select("query_id", "reason")


@query(f"""WITH {SIDE_SQL}, a AS (SELECT query_id, r, answer, CASE WHEN arithmetic = 'ok' THEN 'insufficient' ELSE 'zero' END AS policy FROM side)
SELECT query_id, r, regexp_matches(answer, '\\[\\[.+?, Page \\d+, Chunk \\d+\\]\\]') OR contains(answer, 'insufficient') OR (policy = 'zero' AND regexp_matches(answer, '(?i)answer\\s*:\\s*0\\b')) AS cited, len(regexp_extract_all(lower(answer), '@@answer:')) = 1 AS one_prefix, NOT contains(answer, 'insufficient') OR policy = 'insufficient' AS policy_kept FROM a""")
def reflected_answers(spark, sf):
    drafts, candidates = _sides(spark, sf)
    a = drafts.select("query_id", F.lit(0).alias("round"), "answer", "arithmetic").unionByName(candidates.select("query_id", "round", "answer", "arithmetic"))
    a = a.select("query_id", F.col("round").cast("long").alias("r"), "answer", F.when(F.col("arithmetic") == "ok", "insufficient").otherwise("zero").alias("missing_data_policy"))
    return L.reflected(a).select("query_id", "r", "cited", "one_prefix", "policy_kept")


@query(f"""WITH {SIDE_SQL}, a AS (SELECT query_id, r, CASE WHEN arithmetic = 'fail' THEN NULL WHEN grounded THEN answer ELSE ' ' || answer || ' ' || answer END AS f FROM side)
SELECT query_id, r, CASE WHEN f IS NULL THEN 'missing string field ''final_answer''' WHEN len(regexp_extract_all(f, '@@ANSWER:')) > 1 THEN 'multiple @@ANSWER prefixes are not allowed' ELSE '' END AS error,
    CASE WHEN f IS NOT NULL AND len(regexp_extract_all(f, '@@ANSWER:')) <= 1 THEN CASE WHEN contains(f, '@@ANSWER:') THEN trim(f) ELSE '@@ANSWER: ' || trim(f) END END AS answer FROM a""")
def structured_answers(spark, sf):
    drafts, candidates = _sides(spark, sf)
    a = drafts.withColumn("round", F.lit(0)).select("query_id", "round", "answer", "arithmetic", "grounded").unionByName(candidates.select("query_id", "round", "answer", "arithmetic", "grounded"))
    f = F.when(F.col("arithmetic") != "fail", F.when(F.col("grounded"), F.col("answer")).otherwise(F.concat(F.lit(" "), "answer", F.lit(" "), "answer")))
    return a.select("query_id", F.col("round").cast("long").alias("r"), A.structured_answer(f).alias("s")).select("query_id", "r", "s.error", "s.answer")


def _chunks(spark, sf) -> DataFrame:
    """Chunks made of the embeddings and the documents of their ids: a Q- channel where the label is odd."""
    e = table(spark, sf, "embeddings").join(table(spark, sf, "documents"), F.col("vec_id") == F.col("doc_id"), "left")
    odd = F.col("label") % 2 == 1
    return e.select("vec_id", F.when(odd, F.col("embedding")).alias("q_minus_embedding"), F.when(odd, F.col("lang")).alias("q_minus_text"), "embedding", F.when(F.col("n_chars") > 300, F.col("text")).alias("text"), F.when(F.col("label") > 4, F.col("embedding")).alias("body_embedding"))


@query("""SELECT 'q_minus' AS channel, vec_id, lang AS channel_text FROM embeddings JOIN documents ON vec_id = doc_id WHERE label % 2 = 1 AND embedding IS NOT NULL AND lang IS NOT NULL
UNION ALL SELECT 'body', vec_id, md5(text) FROM embeddings JOIN documents ON vec_id = doc_id WHERE n_chars > 300 AND embedding IS NOT NULL AND text IS NOT NULL""")
def channels(spark, sf):
    c = _chunks(spark, sf)
    one = lambda name, shown: A.channel_rows(c, name).select(F.lit(name).alias("channel"), "vec_id", shown.alias("channel_text"))
    return one("q_minus", F.col("channel_text")).unionByName(one("body", F.md5("channel_text")))


@query("SELECT vec_id, label % 2 = 1 AS from_question, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND (label % 2 = 1 OR label > 4)")
def primary_embeddings(spark, sf):
    p = A.primary_vectors(_chunks(spark, sf).drop("embedding"))
    return p.select("vec_id", F.col("q_minus_embedding").isNotNull().alias("from_question"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("SELECT vec_id, CASE WHEN n_chars > 300 AND length(trim(text)) > 0 THEN len(embedding) ELSE 0 END AS n FROM embeddings LEFT JOIN documents ON vec_id = doc_id")
def sparse_embeddings(spark, sf):
    return A.sparse_vectors(_chunks(spark, sf), "text", "embedding").select("vec_id", F.size("embedding").cast("long").alias("n"))


@query("SELECT doc_id, md5(left(coalesce(text, ''), 300)) AS text_md5 FROM documents")
def truncated_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(A.truncated("text", 100)).alias("text_md5"))


@query(f"""WITH q AS (SELECT doc_id, s[1] AS query, s AS p FROM (SELECT doc_id, {SENTENCES} AS s FROM documents) WHERE len(s) > 0),
e AS (SELECT doc_id, query, i, p[i] AS x, trim(regexp_replace(lower(p[i]), '\\s+', ' ', 'g')) AS k FROM q, unnest(range(1, len(p) + 1)) AS u(i)),
o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY i) = 1)
SELECT doc_id AS query_id, md5(x) AS rewrite_md5 FROM o WHERE k <> trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 2""")
def query_rewrites(spark, sf):
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), T.sentences("text").alias("proposals")).where(F.size("proposals") > 0).withColumn("query", F.get("proposals", F.lit(0)))
    return fusion.rewrites(q).select("query_id", F.md5("rewrite").alias("rewrite_md5"))


@query("SELECT d.doc_id AS query_id, n_chars AS place, f.id FROM documents d JOIN (SELECT text, min(doc_id) AS id FROM documents GROUP BY text) f USING (text)")
def first_nodes_by_text(spark, sf):
    d = table(spark, sf, "documents")
    return A.nodes_by_text(d.select(F.col("doc_id").alias("query_id"), F.col("n_chars").alias("place"), "text"), d.select(F.col("doc_id").alias("id"), "text"))


@query("SELECT conv_id AS query_id, turn AS place, CASE WHEN role = 'user' THEN 'Unknown' ELSE role END AS title, CASE WHEN turn % 2 = 0 THEN 0 ELSE CAST(turn AS INTEGER) END AS page, CASE WHEN length(text) > 200 THEN -1 ELSE CAST(turn AS INTEGER) END AS sent_id, md5(coalesce(text, '')) AS text_md5 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 4")
def adapter_nodes(spark, sf):
    c, turn = table(spark, sf, "conversations"), F.col("turn").cast("int")
    n = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), F.when(F.col("role") != "user", F.col("role")).alias("title"), F.when(turn % 2 != 0, turn).alias("page"), F.when(F.length("text") <= 200, turn).alias("sent_id"), "text")
    return A.nodes_filled(n, 4, 3).select("query_id", "place", "title", "page", "sent_id", F.md5("text").alias("text_md5"))


@query("""WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
SELECT conv_id AS query_id, md5(string_agg('[[' || role || ', Page ' || turn || ', Chunk ' || turn || ']]' || chr(10) || left(t, CASE WHEN conv_id > 10 THEN 1400 ELSE 760 END), chr(10) || chr(10) ORDER BY place)) AS excerpt_md5 FROM c WHERE place <= 8 GROUP BY conv_id""")
def context_excerpts(spark, sf):
    from pyspark.sql import Window as W

    c, turn = table(spark, sf, "conversations"), F.col("turn").cast("int")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    n = c.select(F.col("conv_id").alias("query_id"), place.alias("place"), F.col("role").alias("title"), turn.alias("page"), turn.alias("sent_id"), "text", F.array().cast("array<string>").alias("terms"), F.when(F.col("conv_id") > 10, "extract").otherwise("boolean").alias("answer_type"))
    return S_.excerpts(n).select("query_id", F.md5("excerpt").alias("excerpt_md5"))


@query("SELECT DISTINCT o_custkey AS query_id, o_orderstatus AS slot_key FROM orders WHERE o_totalprice < 60000")
def trusted_missing(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderstatus").alias("slot_key"), "o_totalprice")
    return A.resolved_missing(o, o.where("false"), o.where("o_totalprice < 60000").select("query_id", "slot_key").distinct(), True)


@query("""SELECT doc_id, md5('{"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}') AS id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL""")
def content_row_ids(spark, sf):
    d = table(spark, sf, "documents").where("lang is not null and source is not null and n_chars is not null")
    return S.with_row_ids(d, "lang", "source", "n_chars").select("doc_id", "id")


@query("SELECT DISTINCT source || '_' || lang AS name, CASE WHEN starts_with(source, 'src1') THEN 'keep' WHEN starts_with(source, 'src') THEN 'drop' ELSE 'ignore' END AS action FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL UNION SELECT DISTINCT lang, 'ignore' FROM documents WHERE lang IS NOT NULL")
def namespace_cleanup(spark, sf):
    d = table(spark, sf, "documents").where("source is not null and lang is not null")
    names = d.select(F.concat("source", F.lit("_"), "lang").alias("name")).union(table(spark, sf, "documents").where("lang is not null").select("lang")).distinct()
    return S.cleanup_plan(names, ["src1"], ["src"])


@query("""WITH f AS (SELECT source AS key, 'out/' || CASE lang WHEN 'de' THEN 'run_' || doc_id || '.json' WHEN 'fr' THEN doc_id || '_summary.json' ELSE doc_id || '.json' END AS path, n_chars AS modified, lang FROM documents WHERE source IS NOT NULL)
SELECT key, arg_max(path, (modified, path)) AS path FROM f WHERE lang NOT IN ('de', 'fr') GROUP BY key""")
def newest_result_files(spark, sf):
    d, i = table(spark, sf, "documents").where("source is not null"), F.col("doc_id").cast("string")
    name = F.when(F.col("lang") == "de", F.concat(F.lit("run_"), i)).when(F.col("lang") == "fr", F.concat(i, F.lit("_summary"))).otherwise(i)
    return S.newest_results(d.select(F.col("source").alias("key"), F.concat(F.lit("out/"), name, F.lit(".json")).alias("path"), F.col("n_chars").alias("modified")))


@query("""SELECT doc_id, md5('| ' || doc_id || ' | ' || coalesce(lang, '') || ' | ' || regexp_replace(replace(coalesce(text, ''), '|', '\\|'), '\\s*\\n\\s*', ' ', 'g') || ' |') AS row_md5 FROM documents""")
def markdown_rows(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.markdown_row("doc_id", "lang", "text")).alias("row_md5"))


@query("SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE doc_id IS NOT NULL")
def written_json_lines(spark, sf):
    """Documents and their languages, written as details and traces and read again as JSON lines."""
    d, folder = table(spark, sf, "documents").where("doc_id is not null"), new_folder(spark)
    S.write_results(d.select("doc_id", "text"), d.select("doc_id", "lang"), folder)
    details, traces = S.json_lines(spark, f"{folder}/details", "doc_id long, text string", strict=True), S.json_lines(spark, f"{folder}/traces", "doc_id long, lang string")
    return details.join(traces, "doc_id").select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("SELECT 'doc' || d.doc_id || '_page_' || l.label || '.txt' AS name FROM documents d JOIN embeddings l ON d.doc_id = l.vec_id WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def sampled_names(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    stem = F.concat(F.lit("doc"), "doc_id", F.lit("_page_"), "label")
    listed = table(spark, sf, "labels").where("quality = 1").select(F.concat(F.lit("doc"), "doc_id").alias("doc"))
    return S.sampled_files(d.select(F.concat(stem, F.lit(".txt")).alias("name"), stem.alias("stem")), listed).select("name")


def _questions(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations").where("text is not null")
    e = F.struct(F.col("role").alias("doc_name"), F.col("turn").alias("page"), F.col("text").alias("text"))
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", e.alias("e")))), lambda x: x["e"]).alias("evidence"))
    return g.select(F.col("conv_id").alias("id"), F.concat(F.lit("Q"), "conv_id").alias("question"), F.lit("a").alias("answer"), "evidence", F.when(F.col("conv_id") > 5, F.concat(F.lit("C"), "conv_id")).alias("company"))


@query("SELECT role AS doc, turn AS page, md5(min(text)) AS text_md5 FROM conversations WHERE text IS NOT NULL GROUP BY role, turn")
def evidence_pages(spark, sf):
    return S.corpus_pages(_questions(spark, sf)).select("doc", "page", F.md5("text").alias("text_md5"))


@query("SELECT conv_id AS id, 'Q' || conv_id AS query, 'a' AS ground_truth, arg_min(role, turn) AS evidence_doc, min(turn) AS evidence_page, CASE WHEN conv_id > 5 THEN 'C' || conv_id ELSE '' END AS company FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def question_table(spark, sf):
    return S.query_table(_questions(spark, sf))


@query("""SELECT conv_id, turn, 0 AS nth, role AS name, '{"q":"' || regexp_extract(text, '[A-Za-z]+') || '","k":' || turn || '}' AS arguments FROM conversations WHERE text IS NOT NULL AND length(text) > 100""")
def textual_tool_calls(spark, sf):
    """Calls in the texts of turns; those of short turns are broken and left out."""
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    good = F.concat(F.lit('<tool_call>{"name":"'), "role", F.lit('","arguments":{"q":"'), word, F.lit('","k":'), "turn", F.lit("}}</tool_call>"))
    c = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.concat(F.left("text", F.lit(20)), F.when(F.length("text") > 100, good).otherwise("<tool_call>{name:}</tool_call>")).alias("response"))
    return L.tool_calls(c, ["conv_id", "turn"], "response").select("conv_id", "turn", "nth", "name", "arguments")


@query("SELECT user_id AS query_id, event_id AS seq, event_type AS step, CAST(CASE WHEN value > 100 THEN 5 ELSE 3 END - CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS INTEGER) AS n_fields, round(value, 3) AS duration_ms FROM events")
def trace_rows(spark, sf):
    e = table(spark, sf, "events")
    big = F.col("value") > 100
    t = L.trace_events(e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("step"), F.when(big, F.col("props")).alias("input"), F.when(big, F.col("props")).alias("output"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"), F.col("value").alias("duration_ms")))
    return t.select("query_id", "seq", F.col("payload")["step"].alias("step"), F.size("payload").alias("n_fields"), F.col("payload")["duration_ms"].cast("double").alias("duration_ms"))


SPAN_SQL = "CASE l_returnflag WHEN 'R' THEN 'three months ended ' WHEN 'A' THEN 'year ended ' ELSE 'in ' END || 'Q' || quarter(l_shipdate) || ' ' || year(l_shipdate) || CASE WHEN l_tax > 0.04 THEN ' versus Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) ELSE '' END"


@query(f"""WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {SPAN_SQL} AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(t), '\\bq([1-4])\\b', 1))), ',') AS quarters, CASE WHEN contains(lower(t), 'three months ended') OR regexp_matches(lower(t), 'q[1-4]') THEN 'quarter' WHEN contains(lower(t), 'year ended') THEN 'annual' ELSE 'unknown' END AS granularity,
    len(list_distinct(regexp_extract_all(t, '(?:19|20)\\d\\d'))) >= 2 OR contains(t, ' versus ') AS multi FROM s""")
def period_marks(spark, sf):
    l = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    q = lambda c: F.concat(F.lit("Q"), F.quarter(c), F.lit(" "), F.year(c))
    t = F.concat(F.when(F.col("l_returnflag") == "R", "three months ended ").when(F.col("l_returnflag") == "A", "year ended ").otherwise("in "), q("l_shipdate"), F.when(F.col("l_tax") > 0.04, F.concat(F.lit(" versus "), q("o_orderdate"))).otherwise(""))
    l = l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", t.alias("t"))  # noqa: E741
    return l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.array_join(F.array_sort(P.quarter_tokens("t")), ",").alias("quarters"), P.marked_granularity("t").alias("granularity"), P.is_multi_period("t", F.lit("")).alias("multi"))


@query(f"SELECT doc_id, lower(coalesce(regexp_extract(text, '[A-Za-z]+'), '')) IN {tuple(['', *T.GENERIC_ENTITIES])} AS generic, regexp_replace(left(text, 40), '[^A-Za-z0-9]', '_', 'g') AS token, md5(lower(regexp_replace(left(text, 60), '[,$\\s]', '', 'g'))) AS value_md5 FROM documents WHERE text IS NOT NULL")
def small_normalisers(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", T.is_generic_entity(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("generic"), T.safe_token(F.left("text", F.lit(40))).alias("token"), F.md5(T.value_key(F.left("text", F.lit(60)))).alias("value_md5"))


STOPWORDS = ("the", "and", "of", "in", "to", "at", "la", "le", "de", "der", "die", "das", "el", "en")


@query(f"SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda w: NOT list_contains({sql_list(STOPWORDS)}, w)))), ' ')) AS terms_md5 FROM documents WHERE text IS NOT NULL")
def content_words(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(F.array_join(F.array_sort(C.content_terms("text", STOPWORDS)), " ")).alias("terms_md5"))


@query(f"SELECT doc_id, md5(CASE WHEN len(s) > 0 THEN array_to_string(s[:2], ' ') ELSE '' END) AS summary_md5 FROM (SELECT doc_id, {SENTENCES} AS s FROM documents WHERE text IS NOT NULL)")
def page_summaries(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(C.page_summary("text")).alias("summary_md5"))


@query(f"WITH {NODES_SQL} SELECT query_id, place, md5(trim(text)) AS text_md5, regexp_matches(text, '\\$') AS exact FROM nodes")
def plain_answers(spark, sf):
    """Nodes' texts without the citations put behind them."""
    n, _ = filings(spark, sf)
    said = F.concat("text", F.lit("  "), T.citation("title", "page", "sent_id"))
    return n.select("query_id", "place", F.md5(A.without_citations(said)).alias("text_md5"), F.contains("text", F.lit("$")).alias("exact"))


@query(f"""WITH {QEDGE_SQL}, used AS (SELECT question_y FROM f1 UNION SELECT question_y FROM f3), heads AS (SELECT doc, min(node) AS src FROM (SELECT DISTINCT node, doc FROM qs) GROUP BY doc)
SELECT src, node AS dst, question FROM qs JOIN heads USING (doc) WHERE question % 2 = 0 AND question NOT IN (SELECT question_y FROM used)""")
def abstract_edges(spark, sf):
    q = vector_questions(spark, sf)
    edges = V.question_edges(q.where("question % 2 = 1"), q.where("question % 2 = 0"), "block")
    return V.abstract_edges(q.where("question % 2 = 0"), edges, q.select("node", "doc").distinct())


HOP_SQL = """WITH n AS (SELECT vec_id AS id, text, embedding AS v FROM embeddings JOIN documents ON vec_id = doc_id WHERE text IS NOT NULL),
q AS (SELECT item_id AS query_id, b.text AS query, v FROM benchmark b JOIN n ON item_id = id),
t AS (SELECT query_id, label AS place, d.text FROM q JOIN embeddings e ON e.vec_id = query_id * 2 JOIN documents d ON d.doc_id = query_id * 2 WHERE label < 5 AND d.text IS NOT NULL),
f AS (SELECT query_id, place, min(id) AS id, 'text' AS "by" FROM t JOIN n USING (text) GROUP BY query_id, place, text),
c AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(list_sum(list_transform(list_zip(q.v, n.v), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / nullif(sqrt(list_sum(list_transform(q.v, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(n.v, lambda x: CAST(x AS DOUBLE) * x))), 0), 0) DESC, id) AS place FROM q, n WHERE query_id NOT IN (SELECT query_id FROM f)),
u AS (SELECT query_id, place, id, "by" FROM f UNION ALL SELECT query_id, place, id, 'vector' FROM c WHERE place <= 10),
s AS (SELECT u.*, round(coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) / nullif(len(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+'))), 0), 0), 10) AS score FROM u JOIN n USING (id) JOIN q USING (query_id))
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, id) AS INTEGER) AS rank, "by" AS found_by FROM s QUALIFY rank <= 5"""


@query(HOP_SQL)
def hop_retrieve(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    e = table(spark, sf, "embeddings")
    nodes = e.join(d, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("id"), "text", "embedding")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    queries = b.join(nodes.select(F.col("id").alias("query_id"), "embedding"), "query_id")
    twice = e.where("label < 5").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("place")).join(d, "doc_id")
    texts = queries.select("query_id", (F.col("query_id") * 2).alias("doc_id")).join(twice, "doc_id").select("query_id", "place", "text")
    return R.hop_retrieve(texts, nodes, queries, 5).withColumnRenamed("by", "found_by")


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, '| ' || l_linenumber || ' | ' || CASE WHEN l_tax > 0.04 THEN '-' ELSE CAST(l_partkey AS VARCHAR) END || ' | ' || l_returnflag || ' |' AS line, 'Line: ' || l_linenumber || CASE WHEN l_tax > 0.04 THEN '' ELSE ', Part: ' || l_partkey END || ', Flag: ' || l_returnflag || '.' AS said FROM lineitem)
SELECT l_orderkey AS order_id, md5('Order ' || l_orderkey || chr(10) || string_agg(said, chr(10) ORDER BY r) || chr(10) || 'a | b' || chr(10) || '| one line |' || chr(10) || 'end') AS text_md5 FROM l GROUP BY l_orderkey""")
def told_tables(spark, sf):
    """Orders as texts with a table of their lines, which becomes sentences; a single line of cells stays."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    row = F.concat(F.lit("| "), "l_linenumber", F.lit(" | "), F.when(F.col("l_tax") > 0.04, "-").otherwise(F.col("l_partkey").cast("string")), F.lit(" | "), "l_returnflag", F.lit(" |"))
    g = l.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("row")))).alias("x"))
    text = F.concat(F.lit("Order "), "order_id", F.lit("\n| Line | Part | Flag |\n"), F.array_join(F.transform("x", lambda x: x["row"]), "\n"), F.lit("\na | b\n| one line |\nend"))
    return g.select("order_id", F.md5(C.with_tables_told(text)).alias("text_md5"))
