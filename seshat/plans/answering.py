"""The answering steps as queries over whole tables: slots, searches, packing, refinement, calculation, turns.

Filings are made from orders and their lines: a node a line, whose text states the line's amounts, dates and flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seshat.operators import calculation as CA
from seshat.operators import packing as K_
from seshat.operators import planning as P_
from seshat.operators import refinement as RF
from seshat.operators import slotfill
from seshat.operators import slots as SL
from seshat.operators import turns as TN
from seshat.plans.queries import SENTENCES, _esc, query, table

NODES_SQL = """nodes AS (SELECT o_custkey AS query_id, (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS place, 'C' || o_custkey || '_' || year(o_orderdate) || '_10K' AS title, CAST(l_linenumber AS INTEGER) AS page, CAST(l_suppkey AS INTEGER) AS sent_id,
    CASE l_returnflag WHEN 'R' THEN 'The income statement of ' || year(l_shipdate) || ' shows net revenues of $' || CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) || ', less returns of (' || CAST(l_quantity AS INTEGER) || ').'
        WHEN 'A' THEN 'Cash flows from investing activities: purchases of property, plant and equipment (capital expenditures) were (' || CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) || ') in ' || year(l_shipdate) || CASE WHEN l_tax > 0.06 THEN ', as a percentage of sales ' || CAST(l_quantity AS INTEGER) || '%.' ELSE '.' END
        ELSE 'Total assets at the end of ' || year(l_shipdate) || ' came to ' || CAST(l_quantity AS INTEGER) || ' lots of ' || CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) || ', total current liabilities to ' || l_partkey || '.' END AS text
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
slots AS (SELECT DISTINCT o_custkey AS query_id, o_orderstatus || year(o_orderdate) AS slot_key, 'FY' || year(o_orderdate) AS period,
    CASE o_orderstatus WHEN 'F' THEN 'Net Revenues' WHEN 'O' THEN 'Capital Expenditures' ELSE 'Total Assets' END AS metric, CASE o_orderstatus WHEN 'F' THEN 'income statement' WHEN 'O' THEN 'cash flow statement' ELSE 'balance sheet' END AS source_anchor FROM orders)"""


def filings(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Nodes and slots of each customer."""
    amount, lots, year = F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.year("l_shipdate").cast("string")
    revenue = F.concat(F.lit("The income statement of "), year, F.lit(" shows net revenues of $"), amount, F.lit(", less returns of ("), lots, F.lit(")."))
    ratio = F.when(F.col("l_tax") > 0.06, F.concat(F.lit(", as a percentage of sales "), lots, F.lit("%."))).otherwise(".")
    capex = F.concat(F.lit("Cash flows from investing activities: purchases of property, plant and equipment (capital expenditures) were ("), amount, F.lit(") in "), year, ratio)
    assets = F.concat(F.lit("Total assets at the end of "), year, F.lit(" came to "), lots, F.lit(" lots of "), amount, F.lit(", total current liabilities to "), F.col("l_partkey").cast("string"), F.lit("."))
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    nodes = lines.select(
        F.col("o_custkey").alias("query_id"), ((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("place"), F.concat(F.lit("C"), "o_custkey", F.lit("_"), F.year("o_orderdate"), F.lit("_10K")).alias("title"), F.col("l_linenumber").cast("int").alias("page"), F.col("l_suppkey").cast("int").alias("sent_id"),
        F.when(F.col("l_returnflag") == "R", revenue).when(F.col("l_returnflag") == "A", capex).otherwise(assets).alias("text"),
    )
    status = F.col("o_orderstatus")
    metric = F.when(status == "F", "Net Revenues").when(status == "O", "Capital Expenditures").otherwise("Total Assets")
    anchor = F.when(status == "F", "income statement").when(status == "O", "cash flow statement").otherwise("balance sheet")
    slots = orders.select(F.col("o_custkey").alias("query_id"), F.concat(status, F.year("o_orderdate")).alias("slot_key"), F.concat(F.lit("FY"), F.year("o_orderdate")).alias("period"), metric.alias("metric"), anchor.alias("source_anchor")).distinct()
    return nodes, slots


def terms_of(metric: str) -> list[str]:
    """A metric's terms in their order, for the SQL: its name, the names it leads to, its words."""
    low = metric.lower()
    every = [low, *(n for triggers, names in SL.ALIASES if any(t in low for t in triggers) for n in names), *low.split()]
    return list(dict.fromkeys(t for t in every if len(t) >= 4))[: slotfill.COUNTED]


def sql_list(items) -> str:
    return "[" + ", ".join(f"'{_esc(x)}'" for x in items) + "]"


SLOT_METRICS = ("Net Revenues", "Capital Expenditures", "Total Assets")
TERM_ROWS = ", ".join(f"('{m}', {sql_list(terms_of(m))})" for m in SLOT_METRICS)
ANCHOR_ROWS = ", ".join(f"('{a}', {sql_list(p)})" for a, p in slotfill.STRICT_ANCHORS.items())
NUMBERS_SQL = "list_transform(regexp_extract_all({0}, '[-+]?\\d[\\d,]*(?:\\.\\d+)?'), lambda t: CAST(replace(replace(t, ',', ''), '+', '') AS DOUBLE))"
NO_YEAR_SQL = "list_filter({0}, lambda v: NOT (v = floor(v) AND abs(v) BETWEEN 1900 AND 2100))"
LITERALS_SQL = NO_YEAR_SQL.format(NUMBERS_SQL)
PRIMARY_SQL = """CASE WHEN regexp_matches({0}, '\\$\\s*\\(?\\d') THEN CAST(regexp_replace(regexp_extract({0}, '\\$\\s*\\(?\\d[\\d,]*(?:\\.\\d+)?'), '[$,(\\s]', '', 'g') AS DOUBLE)
    WHEN regexp_matches({0}, '\\(\\s*\\d[\\d,]*(?:\\.\\d+)?\\s*\\)') THEN -CAST(regexp_replace(regexp_extract({0}, '\\(\\s*\\d[\\d,]*(?:\\.\\d+)?\\s*\\)'), '[,()\\s]', '', 'g') AS DOUBLE) ELSE """ + LITERALS_SQL + "[1] END"
ANY_SQL = "len(list_filter({0}, lambda m: contains({1}, m))) > 0"
# years of a text: runs of exactly four digits
YEARS_SQL = "list_distinct(list_filter(regexp_extract_all({0}, '\\d+'), lambda y: length(y) = 4 AND (y[:2] = '19' OR y[:2] = '20')))"
FILL_SQL = f"""WITH {NODES_SQL},
words AS (SELECT * FROM (VALUES {TERM_ROWS}) AS t(metric, terms)), marks AS (SELECT * FROM (VALUES {ANCHOR_ROWS}) AS t(source_anchor, phrases)),
n AS (SELECT *, lower(text) AS low, {YEARS_SQL.format("text")} AS said, {YEARS_SQL.format("title")} AS named, {LITERALS_SQL.format("text")} AS figures, {PRIMARY_SQL.format("text")} AS whole FROM nodes),
s AS (SELECT *, [substr(period, 3)] AS asked, metric = 'Capital Expenditures' AS capex, metric <> 'Capital Expenditures' AS large FROM slots JOIN words USING (metric) JOIN marks USING (source_anchor)),
j AS (SELECT *, len(list_filter(terms, lambda t: contains(low, t))) AS hits, len(list_intersect(asked, said)) > 0 AS y, len(list_intersect(asked, named)) > 0 AS ty FROM s JOIN n USING (query_id)),
k AS (SELECT *, 2 * hits + CASE WHEN y THEN 4 WHEN ty THEN 1 WHEN len(said) = 0 AND len(named) = 0 THEN 1 ELSE 0 END + 1 AS base FROM j WHERE hits > 0 AND CASE WHEN len(said) > 0 THEN y ELSE len(named) = 0 OR ty END
    AND (NOT capex OR ({ANY_SQL.format(sql_list(SL.CAPEX_AMOUNTS), "low")} AND NOT {ANY_SQL.format(sql_list(SL.CAPEX_RATIOS), "low")}))
    AND ({ANY_SQL.format("phrases", "lower('[[' || title || ', Page ' || page || ', Chunk ' || sent_id || ']] ' || text)")} OR (NOT capex AND (contains(low, split_part(source_anchor, ' ', 1)) OR contains(low, split_part(source_anchor, ' ', 2)) OR y OR ty)))),
m AS (SELECT query_id, slot_key, place, low, text, i, terms[i] AS mark, 36 AS before, 140 AS behind, string_split(low, terms[i]) AS parts FROM k, unnest(range(1, least(len(terms), 10) + 1)) AS u(i)
    UNION ALL SELECT query_id, slot_key, place, low, text, 100 + i, asked[i], 24, 110, string_split(text, asked[i]) FROM k, unnest(range(1, len(asked) + 1)) AS u(i)),
p AS (SELECT *, list_sum(list_transform(parts[:h], lambda x: length(x))) + (h - 1) * length(mark) AS pos FROM m, unnest(range(1, len(parts))) AS u(h)),
w AS (SELECT query_id, slot_key, place, i, h, substr(text, CAST(greatest(0, pos - before) + 1 AS BIGINT), CAST(pos + length(mark) + behind - greatest(0, pos - before) AS BIGINT)) AS w FROM p),
v AS (SELECT query_id, slot_key, place, i, h, {PRIMARY_SQL.format("w")} AS v FROM w),
c AS (SELECT k.query_id, k.slot_key, k.place, i, h, v, 2 AS priority FROM k JOIN v USING (query_id, slot_key, place) WHERE v IS NOT NULL
    UNION ALL SELECT query_id, slot_key, place, 0, 0, whole, 0 FROM k WHERE (query_id, slot_key, place) NOT IN (SELECT (query_id, slot_key, place) FROM v WHERE v IS NOT NULL) AND whole IS NOT NULL),
t AS (SELECT k.*, i, h, priority + base AS score, CASE WHEN large AND abs(v) < 100 THEN list_filter(figures, lambda f: abs(f) = list_max(list_transform(figures, lambda g: abs(g))))[1] ELSE v END AS value FROM c JOIN k USING (query_id, slot_key, place) WHERE NOT (v = floor(v) AND abs(v) BETWEEN 1900 AND 2100)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, slot_key ORDER BY score DESC, place, i, h) AS best FROM t WHERE NOT (large AND (value IS NULL OR abs(value) < 100)))
SELECT query_id, slot_key, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE regexp_replace(format('{{:.8f}}', x), '\\.?0+$', '') END AS value, '[[' || title || ', Page ' || page || ', Chunk ' || sent_id || ']]' AS citation, CAST(score AS INTEGER) AS score
FROM (SELECT *, CASE WHEN capex AND value < 0 THEN -value ELSE value END AS x FROM r WHERE best = 1)"""


@query(FILL_SQL)
def slot_fill(spark, sf):
    nodes, slots = filings(spark, sf)
    return slotfill.filled_slots(slots, nodes)


# --- planning and guarded searches ---------------------------------------------------------------------------------

LEGAL_SQL = sql_list(P_.LEGAL_FORMS)
ALIASES_SQL = f"""list_filter([lower(regexp_replace(lower({{0}}), '[^a-z0-9]+', '', 'g'))] || [array_to_string(list_filter(string_split_regex(lower({{0}}), '[^a-z0-9]+'), lambda w: NOT list_contains({LEGAL_SQL}, w)), '')]
    || list_filter(string_split_regex(lower({{0}}), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains({LEGAL_SQL}, w)), lambda w: length(w) > 0)"""
STATES_SQL = f"""{NODES_SQL},
states AS (SELECT o_custkey AS query_id, 'What was it for customer ' || o_custkey || '?' AS query, CASE WHEN count(*) % 3 = 0 THEN 'compute' WHEN count(*) % 3 = 1 THEN 'extract' ELSE 'list' END AS answer_type, CASE WHEN max(o_totalprice) > 450000 THEN 'company' ELSE 'C' || o_custkey || ' Holdings Inc' END AS entity,
    'FY' || min(year(o_orderdate)) || CASE WHEN min(year(o_orderdate)) < max(year(o_orderdate)) THEN ' and FY' || max(year(o_orderdate)) ELSE '' END AS period, CASE min(o_orderstatus) WHEN 'F' THEN 'Net_Revenues' WHEN 'O' THEN 'Capital Expenditures' ELSE 'Total Assets' END AS metric,
    CASE WHEN min(o_orderpriority) < '2' THEN 'cash flow statement' ELSE '' END AS source_anchor, CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS n_required FROM orders GROUP BY o_custkey),
missing AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY slot_key) AS s, '' AS entity, period, metric, source_anchor FROM slots)"""


def states(spark, sf) -> DataFrame:
    """Query states made of a customer's orders, with the slots of filings as the missing ones."""
    orders, (_, slots) = table(spark, sf, "orders"), filings(spark, sf)
    n, year = F.count("*") % 3, F.year("o_orderdate")
    first, last = F.min(year), F.max(year)
    s = orders.groupBy(F.col("o_custkey").alias("query_id")).agg(
        F.when(n == 0, "compute").when(n == 1, "extract").otherwise("list").alias("answer_type"), F.when(F.max("o_totalprice") > 450000, "company").alias("generic"),
        F.concat(F.lit("FY"), first, F.when(first < last, F.concat(F.lit(" and FY"), last)).otherwise("")).alias("period"), F.when(F.min("o_orderstatus") == "F", "Net_Revenues").when(F.min("o_orderstatus") == "O", "Capital Expenditures").otherwise("Total Assets").alias("metric"),
        F.when(F.min("o_orderpriority") < "2", "cash flow statement").otherwise("").alias("source_anchor"), F.count_distinct("o_orderstatus").cast("int").alias("n_required"),
    )
    s = s.withColumn("query", F.concat(F.lit("What was it for customer "), "query_id", F.lit("?"))).withColumn("entity", F.coalesce("generic", F.concat(F.lit("C"), "query_id", F.lit(" Holdings Inc")))).drop("generic")
    m = slots.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot_key", F.lit("").alias("entity"), "period", "metric", "source_anchor"))), lambda x: F.struct(x["entity"], x["period"], x["metric"], x["source_anchor"])).alias("missing"))
    return s.join(m, "query_id")


def all_terms(metric: str) -> list[str]:
    low = " ".join(metric.lower().replace("_", " ").split())
    return list(dict.fromkeys([low, *(n for triggers, names in SL.ALIASES if any(t in low for t in triggers) for n in names), *(w for w in low.split() if len(w) >= 4)]))


ALL_TERM_ROWS = ", ".join(f"('{m}', {sql_list(all_terms(m))})" for m in ("Net Revenues", "Net_Revenues", "Capital Expenditures", "Total Assets"))
STRICT_SQL = "CASE {0} " + " ".join(f"WHEN '{a}' THEN {sql_list(p)}" for a, p in slotfill.STRICT_ANCHORS.items()) + " ELSE [] END"
KEYWORDS_SQL = "list_filter([lower({0})] || list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: length(w) >= 3), lambda w: length(w) > 0)"
SEARCH_ALIASES_SQL = f"CASE WHEN {{0}} IN ('', 'company') THEN [] ELSE [{{0}}] || [{ALIASES_SQL}[1]] || list_filter({ALIASES_SQL}, lambda w: length(w) >= 4) END"
TERMS_SQL = f"""WITH {STATES_SQL}, words AS (SELECT * FROM (VALUES {ALL_TERM_ROWS}) AS t(metric, terms)),
st AS (SELECT *, CASE WHEN entity = 'company' THEN '' ELSE entity END AS named, (SELECT count(*) FROM missing m WHERE m.query_id = states.query_id) AS n_missing FROM states JOIN words USING (metric)),
mi AS (SELECT m.query_id, m.s, m.period AS p, lower(m.metric) AS m, m.source_anchor AS a, w.terms, st.named AS e, st.answer_type FROM missing m JOIN words w USING (metric) JOIN st USING (query_id)),
lists AS (
    SELECT query_id, 1 AS block, s, [CASE WHEN e <> '' THEN concat_ws(' ', e, p, m, a) END, CASE WHEN e <> '' THEN concat_ws(' ', e, p, m) END, CASE WHEN e <> '' THEN concat_ws(' ', e, m, a) END, concat_ws(' ', p, m, a), concat_ws(' ', p, m), concat_ws(' ', m, a), p] AS l FROM mi WHERE answer_type = 'compute'
    UNION ALL SELECT query_id, 2, 0, [entity, period, metric, source_anchor] || {SEARCH_ALIASES_SQL.format("entity")} || terms[:CASE WHEN answer_type = 'list' THEN 10 ELSE 6 END] FROM st
    UNION ALL SELECT query_id, 3, s, [p, m] || terms[:CASE WHEN answer_type = 'list' THEN 10 ELSE 6 END] || [a] || {KEYWORDS_SQL.format("a")} || ({STRICT_SQL.format("a")})[:4] FROM mi
    UNION ALL SELECT query_id, 4, 0, [concat_ws(' ', entity, period, metric), CASE WHEN source_anchor <> '' THEN concat_ws(' ', entity, period, metric, source_anchor) END] || {KEYWORDS_SQL.format("source_anchor")} || ({STRICT_SQL.format("source_anchor")})[:4] || [query] FROM st),
flat AS (SELECT query_id, block, s, i, l[i] AS t FROM lists, unnest(range(1, len(l) + 1)) AS u(i) WHERE l[i] IS NOT NULL AND trim(l[i]) <> ''),
once AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(t)) ORDER BY block, s, i) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY block, s, i) AS nth FROM once)
SELECT query_id, nth - 1 AS nth, t AS term FROM placed JOIN st USING (query_id) WHERE nth <= CASE WHEN answer_type = 'compute' THEN CASE WHEN n_missing >= 4 THEN 30 WHEN n_missing >= 2 THEN 24 ELSE 20 END WHEN n_required >= 2 OR n_missing >= 2 THEN 24 ELSE 12 END"""


@query(TERMS_SQL)
def planned_terms(spark, sf):
    t = P_.search_terms(states(spark, sf)).select("query_id", F.posexplode("terms").alias("nth", "term"))
    return t.select("query_id", F.col("nth").cast("long").alias("nth"), "term")


#: A search is by the words of the metric alone; where it is tried again, by those of the company, period and question.
WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: length(w) > 0))"
GUARD_SQL = f"""WITH {STATES_SQL},
held AS (SELECT query_id, place AS id, {YEARS_SQL.format("title")} AS named, {WORDS_SQL.format("title || ' ' || text")} AS held FROM nodes),
q AS (SELECT *, {YEARS_SQL.format("period")} AS asked, entity = 'company' AS generic FROM states),
hits AS (SELECT query_id, id, named, len(list_intersect(held, {WORDS_SQL.format("metric")})) AS a,
    len(list_intersect(held, {WORDS_SQL.format("array_to_string(list_transform([entity, replace(lower(entity), ' ', '')], lambda x: x || ' ' || x || ' ' || period || ' ' || metric || ' ' || x || ' ' || query) || list_filter(string_split(lower(entity), ' '), lambda w: length(w) >= 4 AND w <> 'holdings'), ' ')")})) AS b FROM held JOIN q USING (query_id)),
first AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, id) AS r FROM hits WHERE a > 0 QUALIFY r <= 5),
f AS (SELECT query_id, count(*) AS raw, count(*) FILTER (generic OR len(list_intersect(asked, named)) > 0) AS kept, count(DISTINCT named[1]) FILTER ((generic OR len(list_intersect(asked, named)) > 0) AND list_contains(asked, named[1])) AS years FROM first JOIN q USING (query_id) GROUP BY query_id),
t AS (SELECT q.*, coalesce(raw, 0) AS raw, coalesce(kept, 0) AS kept, CASE WHEN NOT generic AND coalesce(raw, 0) > 0 THEN CASE WHEN answer_type = 'compute' AND len(asked) >= 2 AND coalesce(years, 0) < 2 THEN 'compute_sparse_year_coverage' WHEN coalesce(kept, 0) = 0 THEN 'initial_empty' END END AS reason FROM q LEFT JOIN f USING (query_id)),
second AS (SELECT h.*, row_number() OVER (PARTITION BY h.query_id ORDER BY b DESC, id) AS r FROM hits h JOIN t ON h.query_id = t.query_id AND reason IS NOT NULL WHERE b > 0 QUALIFY r <= 5),
g AS (SELECT query_id, count(*) AS retry_raw, count(*) FILTER (len(list_intersect(asked, named)) > 0) AS retry_kept FROM second JOIN q USING (query_id) GROUP BY query_id),
d AS (SELECT t.*, coalesce(retry_raw, 0) AS retry_raw, coalesce(retry_kept, 0) AS retry_kept, CASE WHEN coalesce(retry_kept, 0) = 0 AND kept = 0 THEN CASE WHEN coalesce(retry_raw, 0) > 0 THEN retry_raw ELSE raw END ELSE 0 END AS relaxed_kept FROM t LEFT JOIN g USING (query_id))
SELECT query_id, raw AS initial_raw, kept AS initial_kept, reason AS retry_reason, retry_raw, retry_kept, relaxed_kept, CASE WHEN retry_kept > 0 THEN 'retry' WHEN kept > 0 THEN 'initial' WHEN relaxed_kept > 0 THEN 'relaxed' ELSE 'nothing' END AS answered_by,
    CASE WHEN retry_kept > 0 THEN (SELECT sum(id) FROM second s WHERE s.query_id = d.query_id AND len(list_intersect(d.asked, s.named)) > 0) WHEN kept > 0 THEN (SELECT sum(id) FROM first s WHERE s.query_id = d.query_id AND (generic OR len(list_intersect(d.asked, s.named)) > 0))
        WHEN retry_raw > 0 THEN (SELECT sum(id) FROM second s WHERE s.query_id = d.query_id) ELSE (SELECT sum(id) FROM first s WHERE s.query_id = d.query_id) END AS ids
FROM d"""


@query(f"SELECT * REPLACE (CAST(ids AS BIGINT) AS ids) FROM ({GUARD_SQL})")
def guarded_search(spark, sf):
    nodes, _ = filings(spark, sf)
    q = states(spark, sf).withColumn("terms", F.array("metric"))
    found, told = P_.guarded_search(q, P_.term_search(nodes.withColumnRenamed("place", "id"), 5))
    return told.join(found.groupBy("query_id").agg(F.sum("id").alias("ids")), "query_id", "left")


# --- atoms and packing ---------------------------------------------------------------------------------------------

BUDGET = 1200
ATOMS_SQL = f"""turns AS (SELECT conv_id AS query_id, turn, role, {SENTENCES} AS s FROM conversations),
atoms AS (SELECT query_id, turn, i, 'a-' || turn || '-' || (i - 1) AS atom_id, '[[' || role || ', Page ' || turn || ', Chunk ' || turn || ']]' AS citation, left(trim(s[i]), 480) AS span FROM turns, unnest(range(1, len(s) + 1)) AS u(i) WHERE length(trim(s[i])) > 0),
metrics AS (SELECT conv_id AS query_id, regexp_extract(lower(arg_min(text, turn)), '[a-z]{{4,}}') AS metric FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
scored AS (SELECT *, CASE WHEN metric <> '' AND contains(lower(citation || ' ' || span), metric) THEN 2.0 ELSE 0.0 END + CASE WHEN contains(lower(citation || ' ' || span), 'assistant') THEN 1.0 ELSE 0.0 END AS priority, citation || chr(10) || span AS block FROM atoms JOIN metrics USING (query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, turn, i, atom_id) AS r FROM scored)"""


def conversation_atoms(spark, sf) -> DataFrame:
    """Sentences of the turns of each conversation, with their priority for its first word of four letters and the assistant."""
    c = table(spark, sf, "conversations")
    turn = F.col("turn").cast("int")
    nodes = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), F.col("role").alias("title"), turn.alias("page"), turn.alias("sent_id"), "text")
    first = c.where("text is not null").groupBy(F.col("conv_id").alias("query_id")).agg(F.regexp_extract(F.lower(F.min_by("text", "turn")), "[a-z]{4,}", 0).alias("metric"))
    asked = first.select("query_id", "metric", F.lit("Assistant").alias("entity"), F.lit("").alias("period"), F.lit("").alias("source_anchor"), F.lit("compute").alias("answer_type"), F.lit(None).cast("array<struct<entity:string,period:string,metric:string,source_anchor:string>>").alias("slots"))
    return K_.prioritised(K_.sound_atoms(K_.sentence_atoms(nodes)), asked)


def _packs_sql(skip: bool) -> str:
    fits = f"f.n = 0 OR f.used + length(k.block) <= {BUDGET}"
    taken = f"({fits})" if skip else f"f.open AND ({fits})"
    return f"""WITH RECURSIVE {ATOMS_SQL},
fold AS (SELECT query_id, 0 AS r, 0 AS used, 0 AS n, '' AS ids, true AS open, '' AS context FROM ranked WHERE r = 1
    UNION ALL SELECT f.query_id, k.r, f.used + CASE WHEN {taken} THEN length(k.block) + 2 ELSE 0 END, f.n + CASE WHEN {taken} THEN 1 ELSE 0 END, f.ids || CASE WHEN {taken} THEN ',' || k.atom_id ELSE '' END, {taken},
        f.context || CASE WHEN {taken} THEN CASE WHEN f.n > 0 THEN chr(10) || chr(10) ELSE '' END || k.block ELSE '' END FROM fold f JOIN ranked k ON k.query_id = f.query_id AND k.r = f.r + 1)
SELECT query_id, CAST(n AS INTEGER) AS n_atoms, substr(ids, 2) AS atom_ids, md5(context) AS context_md5 FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC) = 1"""


def _packs(packs: DataFrame) -> DataFrame:
    return packs.select("query_id", F.size("atom_ids").alias("n_atoms"), F.array_join("atom_ids", ",").alias("atom_ids"), F.md5("context").alias("context_md5"))


@query(_packs_sql(False))
def packed_atoms(spark, sf):
    return _packs(K_.packed(conversation_atoms(spark, sf), BUDGET, [-F.col("priority"), F.col("nth")]))


@query(_packs_sql(True))
def packed_atoms_skipping(spark, sf):
    return _packs(K_.packed(conversation_atoms(spark, sf), BUDGET, [-F.col("priority"), F.col("nth")], skip=True))


@query(f"""WITH {NODES_SQL}, words AS (SELECT * FROM (VALUES {ALL_TERM_ROWS}) AS t(metric, terms)),
a AS (SELECT n.query_id, n.place, s.slot_key, lower('[[' || title || ', Page ' || page || ', Chunk ' || sent_id || ']] ' || trim(left(text, 480))) AS said, terms, {YEARS_SQL.format("period")} AS years, {KEYWORDS_SQL.format("source_anchor")} AS anchors, split_part(title, '_', 1) AS company FROM nodes n JOIN slots s USING (query_id) JOIN words USING (metric)),
h AS (SELECT *, len(list_filter(terms, lambda t: length(t) >= 3 AND contains(said, t))) AS hits, len(list_filter(years, lambda y: contains(said, y))) AS dated FROM a)
SELECT query_id, slot_key, CAST(max(score) AS DOUBLE) AS best, count(*) AS n FROM (SELECT *, least(3.0, 1.5 + 0.5 * hits) + least(2.0, dated) + CASE WHEN len(list_filter(anchors, lambda t: contains(said, t))) > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN company = 'C' || query_id THEN 1.0 ELSE 0.0 END AS score FROM h WHERE hits > 0 AND dated > 0) GROUP BY ALL""")
def aligned_atoms(spark, sf):
    nodes, slots = filings(spark, sf)
    atoms = nodes.select("query_id", F.col("place").alias("nth"), F.col("place").cast("string").alias("atom_id"), K_.T.citation("title", "page", "sent_id").alias("citation"), F.col("text").alias("span"))
    a = K_.aligned(K_.sound_atoms(atoms), slots.withColumn("entity", F.concat(F.lit("C"), "query_id")))
    return a.groupBy("query_id", "slot_key").agg(F.max("alignment").alias("best"), F.count("*").alias("n"))


# --- refinement, turns, gates, calculation -------------------------------------------------------------------------

ROUNDS = 3
#: A user's events in order: the first is the draft, the next what each round would make of it.
SIDE_SQL = """side AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r,
    CASE event_type WHEN 'error' THEN '@@ANSWER: insufficient evidence' WHEN 'view' THEN '@@ANSWER: ' || CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) WHEN 'click' THEN CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR)
        ELSE '@@ANSWER: ' || CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) || ' [[E_2024, Page 1, Chunk ' || event_id || ']]' END AS answer,
    props AS critique, CASE WHEN value < 10 THEN 'fail' WHEN value < 60 THEN 'ok' ELSE 'na' END AS arithmetic, CASE WHEN value > 150 THEN ['Cross-company evidence', props] WHEN value > 40 THEN [props] WHEN value > 20 THEN ['fabricated_claim in ' || event_type] ELSE [] END AS issues,
    value > 70 AS passed, value > 25 AS grounded FROM events),
policies AS (SELECT user_id AS query_id, CASE WHEN max(value) > 300 THEN 'zero_if_not_explicit' WHEN max(value) > 200 THEN 'inapplicable_explain' ELSE 'insufficient' END AS policy, CAST(count(*) FILTER (event_type = 'error') > 12 AS INTEGER) AS n_missing FROM events GROUP BY user_id)"""
CITED_SQL = "regexp_matches({0}.answer, '\\[\\[.+?, Page \\d+, Chunk \\d+\\]\\]')"
RANK_SQL = """[CAST({0}.passed AS INTEGER), CAST({0}.grounded AS INTEGER), CAST(NOT contains({0}.answer, 'insufficient') AS INTEGER), -len({0}.issues), CASE {0}.arithmetic WHEN 'ok' THEN 2 WHEN 'na' THEN 1 ELSE 0 END, CAST(""" + CITED_SQL + " AS INTEGER), CAST(contains({0}.answer, '@@ANSWER:') AS INTEGER)]"
FOREIGN_SQL = "len(list_filter({0}.issues, lambda i: contains(lower(i), 'cross-company'))) > 0"
REFINED_SQL = f"""WITH RECURSIVE {SIDE_SQL},
loop AS (SELECT query_id, 0 AS n, struct_pack(answer := answer, critique := critique, arithmetic := arithmetic, issues := issues, passed := passed, grounded := grounded) AS s, CAST(NULL AS VARCHAR) AS outcome, policy, n_missing FROM side JOIN policies USING (query_id) WHERE r = 0
    UNION ALL SELECT query_id, CASE WHEN need THEN n + 1 ELSE n END, CASE WHEN need AND keep THEN a ELSE s END,
        CASE WHEN NOT need THEN 'sound' WHEN NOT keep OR (lower(a.answer) = lower(s.answer) AND a.critique = s.critique AND a.arithmetic = s.arithmetic AND a.issues = s.issues) THEN 'at rest' END, policy, n_missing
    FROM (SELECT *, CASE WHEN NOT contains(s.answer, 'insufficient') AND contains(a.answer, 'insufficient') THEN (NOT s.passed AND {FOREIGN_SQL.format("s")}) OR (policy = 'insufficient' AND NOT s.passed AND NOT a.passed AND len(a.issues) < len(s.issues))
            WHEN contains(s.answer, 'insufficient') AND NOT contains(a.answer, 'insufficient') THEN {CITED_SQL.format("a")} OR ({RANK_SQL.format("a")})[3:] > ({RANK_SQL.format("s")})[3:] ELSE {RANK_SQL.format("a")} > {RANK_SQL.format("s")} END AS keep
        FROM (SELECT l.query_id, l.n, l.s, l.policy, l.n_missing, NOT l.s.passed OR NOT contains(l.s.answer, '@@ANSWER:') OR (contains(l.s.answer, 'insufficient') AND l.n_missing = 0) OR NOT {CITED_SQL.format("l.s")} AS need,
            CASE WHEN c.query_id IS NULL THEN l.s ELSE struct_pack(answer := CASE WHEN {CITED_SQL.format("l.s")} AND NOT {CITED_SQL.format("c")} THEN c.answer || ' ' || regexp_extract(l.s.answer, '\\[\\[.*\\]\\]') ELSE c.answer END, critique := c.critique, arithmetic := c.arithmetic, issues := c.issues, passed := c.passed, grounded := c.grounded) END AS a
            FROM loop l LEFT JOIN side c ON c.query_id = l.query_id AND c.r = l.n + 1 WHERE l.outcome IS NULL AND l.n < {ROUNDS}))),
ends AS (SELECT *, NOT s.passed AND (s.arithmetic = 'fail' OR len(list_filter(s.issues, lambda i: contains(lower(i), 'fabricated_claim') OR contains(lower(i), 'cross-company'))) > 0) AND (coalesce(outcome, '') = 'at rest' OR NOT contains(s.answer, 'insufficient')) AS lost
    FROM loop QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, outcome IS NULL) = 1)
SELECT query_id, CASE WHEN lost THEN '@@ANSWER: insufficient evidence' ELSE s.answer END AS answer, s.passed AS passed, CAST(n AS INTEGER) AS n_rounds, CASE WHEN lost THEN 'given up' ELSE coalesce(outcome, 'rounds spent') END AS outcome FROM ends"""


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    e, v, kind = table(spark, sf, "events"), F.col("value"), F.col("event_type")
    amount = v.cast("decimal(18,2)").cast("string")
    answer = F.when(kind == "error", "@@ANSWER: insufficient evidence").when(kind == "view", F.concat(F.lit("@@ANSWER: "), amount)).when(kind == "click", amount).otherwise(F.concat(F.lit("@@ANSWER: "), amount, F.lit(" [[E_2024, Page 1, Chunk "), "event_id", F.lit("]]")))
    issues = F.when(v > 150, F.array(F.lit("Cross-company evidence"), "props")).when(v > 40, F.array("props")).when(v > 20, F.array(F.concat(F.lit("fabricated_claim in "), kind))).otherwise(F.array().cast("array<string>"))
    s = e.select(F.col("user_id").alias("query_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("round"), answer.alias("answer"), F.col("props").alias("critique"), F.when(v < 10, "fail").when(v < 60, "ok").otherwise("na").alias("arithmetic"), issues.alias("issues"), (v > 70).alias("passed"), (v > 25).alias("grounded"))
    p = e.groupBy(F.col("user_id").alias("query_id")).agg(F.when(F.max("value") > 300, "zero_if_not_explicit").when(F.max("value") > 200, "inapplicable_explain").otherwise("insufficient").alias("policy"), (F.count_if(kind == "error") > 12).cast("int").alias("n_missing"))
    return s.where("round = 0").drop("round").join(p, "query_id"), s.where("round > 0")


@query(REFINED_SQL)
def refined_answers(spark, sf):
    drafts, candidates = _sides(spark, sf)
    return RF.refined(drafts, candidates, ROUNDS, rejudge=True)


TURNS_SQL = """WITH RECURSIVE t AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, event_type IN ('view', 'click', 'error') AS tool, event_type = 'purchase' AND value > 60 AS answered, [props, event_type] AS found, CAST(value > 80 AS INTEGER) AS new_entries,
    sum(CAST(value > 80 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS ledger, user_id % 3 AS n_required FROM events),
k AS (SELECT *, greatest(0, n_required - ledger) AS missing FROM t),
fold AS (SELECT DISTINCT user_id AS query_id, 0 AS r, 0 AS n, 0 AS calls, CAST([] AS VARCHAR[]) AS seen, 0 AS idle, CAST(0 AS BIGINT) AS ledger, CAST(user_id % 3 AS BIGINT) AS missing, user_id % 3 AS n_required, CAST(NULL AS VARCHAR) AS why FROM events
    UNION ALL SELECT f.query_id, k.r, CASE WHEN w IS NULL THEN f.n + 1 ELSE f.n END, CASE WHEN w IS NULL AND k.tool THEN f.calls + 1 ELSE f.calls END, CASE WHEN w IS NULL AND k.tool THEN list_distinct(f.seen || k.found) ELSE f.seen END,
        CASE WHEN w IS NULL AND k.tool THEN CASE WHEN k.new_entries = 0 AND k.missing > 0 THEN f.idle + 1 ELSE 0 END ELSE f.idle END, CAST(CASE WHEN w IS NULL AND k.tool THEN k.ledger ELSE f.ledger END AS BIGINT), CAST(CASE WHEN w IS NULL AND k.tool THEN k.missing ELSE f.missing END AS BIGINT), f.n_required,
        CASE WHEN w IS NOT NULL THEN w WHEN NOT k.tool AND k.answered THEN 'answered' END
    FROM (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN calls > 1 AND CASE WHEN n_required > 0 THEN missing = 0 AND ledger >= n_required ELSE ledger > 0 END THEN 'covered' WHEN calls >= 3 THEN 'calls spent' END AS w FROM fold) f JOIN k ON k.query_id = f.query_id AND k.r = f.r + 1 AND k.r <= 6),
z AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC) = 1),
s AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN n < 6 AND calls > 1 AND CASE WHEN n_required > 0 THEN missing = 0 AND ledger >= n_required ELSE ledger > 0 END THEN 'covered' WHEN n < 6 AND calls >= 3 THEN 'calls spent' WHEN n >= 6 THEN 'turns spent' ELSE 'no more turns' END AS stopped FROM z)
SELECT query_id, CAST(n AS INTEGER) AS n_turns, CAST(calls AS INTEGER) AS n_calls, CAST(len(seen) AS INTEGER) AS n_seen, CAST(idle AS INTEGER) AS no_progress, stopped, stopped <> 'answered' AS forced FROM s"""


@query(TURNS_SQL)
def folded_turns(spark, sf):
    e = table(spark, sf, "events")
    new, required = (F.col("value") > 80).cast("int"), F.col("user_id") % 3
    ledger = F.sum(new).over(W.partitionBy("user_id").orderBy("event_id"))
    kind = F.col("event_type")
    turns = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("turn"), kind.isin("view", "click", "error").alias("tool"), ((kind == "purchase") & (F.col("value") > 60)).alias("answered"), F.array("props", "event_type").alias("found"), new.alias("new_entries"), ledger.alias("ledger"), F.greatest(F.lit(0), required - ledger).alias("missing"))
    runs = e.select(F.col("user_id").alias("query_id"), required.alias("n_required"), F.lit(None).cast("array<string>").alias("bootstrap")).distinct()
    return TN.ran(turns, runs)


GATED_SQL = """WITH e AS (SELECT o_custkey AS query_id, o_orderkey AS nth, o_orderstatus || year(o_orderdate) AS slot_key, CASE WHEN o_totalprice < 20000 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END AS value, o_orderpriority, o_totalprice FROM orders),
s AS (SELECT query_id, count(*) % 4 = 0 AS free FROM e GROUP BY query_id),
k AS (SELECT e.*, free, free OR NOT (o_orderpriority < '3' OR o_totalprice > 200000) AS kept FROM e JOIN s USING (query_id)),
l AS (SELECT query_id, slot_key, bool_or(value <> 'n/a') AND NOT coalesce(bool_or(value <> 'n/a') FILTER (kept), false) AS lost, bool_or(kept) AS any_kept, min(nth) AS first FROM k GROUP BY ALL),
b AS (SELECT k.*, lost AND NOT any_kept AND nth = first AS back FROM k JOIN l USING (query_id, slot_key)),
c AS (SELECT *, bool_or(kept OR back) OVER (PARTITION BY query_id) AS held_any, min(nth) OVER (PARTITION BY query_id) AS top FROM b)
SELECT query_id, nth, slot_key, value, CASE WHEN free THEN 'bypass' WHEN kept THEN 'gate' ELSE 'fallback' END AS kept_by FROM c WHERE kept OR back OR (NOT held_any AND nth = top)"""


def _entries(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    value = F.when(F.col("o_totalprice") < 20000, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("nth"), F.concat("o_orderstatus", F.year("o_orderdate")).alias("slot_key"), value.alias("value"), "o_orderpriority", "o_totalprice")


@query(GATED_SQL)
def gated_entries(spark, sf):
    e = _entries(spark, sf)
    states_ = e.groupBy("query_id").agg(F.when(F.count("*") % 4 == 0, "compute").otherwise("extract").alias("answer_type"))
    decisions = e.where((F.col("o_orderpriority") < "3") | (F.col("o_totalprice") > 200000)).select("query_id", "nth", F.lit(False).alias("keep"))
    return TN.gated(e.select("query_id", "nth", "slot_key", "value"), decisions, e.select("query_id", "slot_key").distinct(), states_)


RESCUE_SQL = """WITH e AS (SELECT o_custkey AS query_id, CASE WHEN o_totalprice < 40000 THEN 'value_period_mismatch' WHEN o_orderstatus = 'P' THEN 'citation_not_in_context' WHEN o_orderpriority < '2' THEN 'entry_gate:guidance' END AS reason, o_orderstatus, o_totalprice FROM orders),
q AS (SELECT query_id, count(*) % 3 = 0 AS compute, count(*) FILTER (o_orderstatus = 'F') AS raw, count(*) FILTER (o_totalprice > 390000) AS accepted, count(DISTINCT o_orderstatus) AS required, count(*) FILTER (o_totalprice < 90000) AS missing, count(*) FILTER (reason IS NULL) AS citations,
    count(*) FILTER (reason = 'value_period_mismatch') AS p, count(*) FILTER (reason = 'citation_not_in_context') AS c FROM e GROUP BY query_id)
SELECT query_id, raw = 0 AND citations > 0 AS zero_entries, missing > 0 AND citations > 0 AND c > 0 AS citation_repair,
    missing > 0 AND CASE WHEN compute THEN citations >= 1 ELSE accepted = 0 AND CASE WHEN citations >= 4 THEN p > 0 OR p + c >= 2 OR required >= 2 ELSE p > 0 AND citations >= 1 END END AS slot_rescue FROM q"""


@query(RESCUE_SQL)
def rescue_triggers(spark, sf):
    o, price = table(spark, sf, "orders"), F.col("o_totalprice")
    reason = F.when(price < 40000, "value_period_mismatch").when(F.col("o_orderstatus") == "P", "citation_not_in_context").when(F.col("o_orderpriority") < "2", "entry_gate:guidance")
    e = o.select(F.col("o_custkey").alias("query_id"), reason.alias("reason"), "o_orderstatus", "o_totalprice")
    counted = e.where("reason is not null").groupBy("query_id", "reason").agg(F.count("*").cast("int").alias("n")).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("reasons"))
    cited = F.count_if(F.col("reason").isNull())
    q = e.groupBy("query_id").agg(
        F.when(F.count("*") % 3 == 0, "compute").otherwise("extract").alias("answer_type"), F.count_if(F.col("o_orderstatus") == "F").alias("entries_raw"), F.count_if(price > 390000).alias("accepted"), F.count_distinct("o_orderstatus").alias("n_required"),
        F.count_if(price < 90000).alias("n_missing"), cited.alias("citations"), F.when(cited > 0, "[[A, Page 1, Chunk 1]] text").otherwise(" ").alias("context"),
    )
    return TN.rescues(q.join(counted, "query_id", "left")).select("query_id", "zero_entries", "citation_repair", "slot_rescue")


COMPUTED_SQL = """WITH l AS (SELECT o_custkey AS query_id, o_orderkey AS nth, 'y' || year(o_orderdate) AS slot_key, year(o_orderdate) AS y, o_totalprice, o_orderstatus <> 'P' AS usable, '[[C' || o_custkey || '_' || year(o_orderdate) || ', Page 1, Chunk ' || o_orderkey || ']]' AS citation, o_orderpriority >= '3' AS in_context FROM orders),
r AS (SELECT query_id, slot_key, y, arg_min(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE), nth) FILTER (usable) AS v, coalesce(arg_min(citation, nth) FILTER (in_context), arg_min(citation, nth)) AS citation FROM l GROUP BY ALL),
g AS (SELECT query_id, count(*) AS n, count(v) AS filled, arg_min(v, y) AS a, arg_max(v, y) AS b, sum(v) AS s, list(v ORDER BY y) AS x, string_agg(citation, ' ' ORDER BY slot_key) AS cited FROM r GROUP BY query_id),
k AS (SELECT query_id, c_mktsegment AS segment FROM g JOIN customer ON c_custkey = query_id),
v AS (SELECT *, list_filter(x, lambda z: z IS NOT NULL) AS known, CASE segment WHEN 'BUILDING' THEN CASE WHEN n >= 2 THEN (b - a) / a * 100 END WHEN 'MACHINERY' THEN CASE WHEN n >= 2 THEN b / a END WHEN 'AUTOMOBILE' THEN s / n WHEN 'HOUSEHOLD' THEN CASE WHEN n >= 2 THEN b - a END ELSE s END AS value FROM g JOIN k USING (query_id))
SELECT query_id, CASE WHEN filled < n THEN 'missing_slots' WHEN value IS NULL THEN 'no_value' END AS error, CASE WHEN filled = n AND value IS NOT NULL THEN round(value, 3) END AS result,
    CASE WHEN filled = n AND value IS NOT NULL THEN CASE WHEN segment = 'BUILDING' THEN '%' ELSE '' END || ' ' || cited END AS tail FROM v"""


@query(COMPUTED_SQL)
def computed_answers(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    year = F.year("o_orderdate")
    key = F.concat(F.lit("y"), year)
    ledger = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("nth"), key.alias("slot_key"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)"))).otherwise("N/A").alias("value"), F.concat(F.lit("[[C"), "o_custkey", F.lit("_"), year, F.lit(", Page 1, Chunk "), "o_orderkey", F.lit("]]")).alias("citation"), (F.col("o_orderpriority") >= "3").alias("in_context"))
    required = o.select(F.col("o_custkey").alias("query_id"), key.alias("slot_key"), F.concat(F.lit("FY"), year).alias("period")).distinct()
    s = F.col("c_mktsegment")
    kind = F.when(s == "BUILDING", "growth").when(s == "MACHINERY", "ratio").when(s == "AUTOMOBILE", "average").when(s == "HOUSEHOLD", "difference").otherwise("sum")
    asked = required.select("query_id").distinct().join(c, F.col("query_id") == F.col("c_custkey")).select("query_id", F.lit("compute").alias("answer_type"), kind.alias("formula"), F.lit(6).alias("rounding"), F.when(s == "BUILDING", "percent").alias("unit"))
    r = CA.computed(asked, required, ledger)
    tail = F.substr("answer", F.lit(11) + F.length("result"))
    return r.select("query_id", "error", F.round(F.col("result").cast("double"), 3).alias("result"), tail.alias("tail"))
