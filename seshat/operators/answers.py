"""Answers, their citations and numbers, run rows and retrieval channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seshat.functions import text as T
from seshat.operators.evidence import CITATION, unique_sources

# What marks a numeric question, and policies for missing data.
NUMERIC_QUERY_MARKERS = ("what is", "how much", "round", "calculate", "average", "year-over-year", "yoy", "ratio", "%", "percent", "margin", "turnover", "dpo", "roa")
NUMERIC_METRIC_KEYS = ("quick ratio", "fixed asset turnover", "return on assets", "days payable outstanding", "dividend payout ratio", "operating margin", "gross margin", "capital expenditure", "revenue", "cogs")
MISSING_DATA_POLICIES = ("insufficient", "zero_if_not_explicit", "inapplicable_explain")
CHANNEL_COLUMNS = {"q_minus": ("q_minus_embedding", "q_minus_text"), "q_plus": ("q_plus_embedding", "q_plus_text"), "body": ("embedding", "text")}
MOST_CHUNKS, CHUNK_LETTERS, POOL_LETTERS = 12, 380, 4500
INLINE = r"(?i)EVIDENCE\s*:\s*(?:value\s*=\s*)?([^|]+?)\s*\|\s*citation\s*=\s*(\[\[[^\]]+?\]\])\s*\|\s*metric\s*=\s*([^\n|]+?)\s*(?:$|\n)"


def is_numeric_query(query: Column | str, metric: Column | str) -> Column:
    """By a marker in the question, or a metric that is computed."""
    return T.contains_any(F.lower(T.text(query)), NUMERIC_QUERY_MARKERS) | T.canonical_metric_key(metric).isin(*NUMERIC_METRIC_KEYS)


def missing_data_policy(value: Column | str) -> Column:
    v = F.lower(F.trim(T.text(value)))
    return F.when(v.isin(*MISSING_DATA_POLICIES), v).otherwise("insufficient")


def first_number(c: Column | str) -> Column:
    """The first number with its commas taken out; null without one."""
    return F.replace(F.regexp_extract(T.text(c), r"[-+]?\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit("")).try_cast("double")


def answer_matches_result(answer: Column | str, result: Column | str) -> Column:
    """Whether an answer states a computed result, as text or to its last decimal (M9)."""
    a, r = (F.replace(F.trim(T.text(c)), F.lit(","), F.lit("")) for c in (answer, result))
    decimals = F.length(F.regexp_extract(r, r"\.([^.]*)$", 1))
    near = F.abs(first_number(a) - first_number(r)) <= F.when(decimals > 0, F.pow(F.lit(10.0), -(decimals + 1))).otherwise(1e-6)
    return (F.length(a) > 0) & (F.length(r) > 0) & (F.contains(a, r) | F.coalesce(near, F.lit(False)))


def structured_answer(final_answer: Column | str) -> Column:
    """struct<answer, error> of a final_answer field (E50): none, empty, or more than one prefix are errors."""
    c = F.col(final_answer) if isinstance(final_answer, str) else final_answer
    a = F.trim(T.text(c))
    error = F.when(c.isNull(), "missing string field 'final_answer'").when(F.length(a) == 0, "empty final_answer").when(F.regexp_count(a, F.lit("@@ANSWER:")) > 1, "multiple @@ANSWER prefixes are not allowed").otherwise("")
    return F.struct(F.when(error == "", F.when(F.contains(a, F.lit("@@ANSWER:")), a).otherwise(F.concat(F.lit("@@ANSWER: "), a))).alias("answer"), error.alias("error"))


def pool_text(rows: DataFrame, by: str, order: str) -> DataFrame:
    """by, pool: each distinct chunk as one line, cut to CHUNK_LETTERS, while lines fit POOL_LETTERS."""
    r = unique_sources(rows.withColumnRenamed("title", "doc"), [by], order).withColumn("body", T.collapsed(T.text("text"))).where(F.length("body") > 0)
    cut = F.when(F.length("body") > CHUNK_LETTERS, F.concat(F.rtrim(F.left(F.col("body"), F.lit(CHUNK_LETTERS))), F.lit("…"))).otherwise(F.col("body"))
    r = r.withColumn("line", F.concat(T.citation("doc", "page", "sent_id"), F.lit(" "), cut))
    w = W.partitionBy(by).orderBy(order)
    r = r.withColumn("n", F.row_number().over(w)).withColumn("total", F.sum(F.length("line") + 1).over(w.rowsBetween(W.unboundedPreceding, 0)))
    kept = r.where((F.col("n") <= MOST_CHUNKS) & ((F.col("total") <= POOL_LETTERS) | (F.col("n") == 1)))
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("pool"))


def inline_evidence(rows: DataFrame, by: list[str], response: str) -> DataFrame:
    """by, nth, value, citation, metric_hint of EVIDENCE lines."""
    c = rows.select(*by, F.posexplode(F.regexp_extract_all(response, F.lit(INLINE), F.lit(0))).alias("nth", "e"))
    return c.select(*by, "nth", *(F.trim(F.regexp_extract("e", INLINE, k)).alias(n) for k, n in ((1, "value"), (2, "citation"), (3, "metric_hint"))))


def bound_pairs(pairs: DataFrame, slots: DataFrame, context: DataFrame) -> DataFrame:
    """pairs with slot_key and reason: the first slot whose metric holds the hint or is held by it.

    pairs: query_id, nth, value, citation, metric_hint; slots: query_id, slot_key, metric, seq; context: query_id,
    context. Each pair meets the slots of its own query.
    """
    s = slots.where(F.length(T.text("metric")) > 0).select("query_id", "slot_key", F.lower("metric").alias("m"), "seq")
    hint = F.lower(T.text("metric_hint"))
    j = pairs.join(s, "query_id").where((F.length(hint) > 0) & (F.contains(F.col("m"), hint) | F.contains(hint, F.col("m"))))
    best = j.groupBy("query_id", "nth").agg(F.min_by("slot_key", "seq").alias("slot_key"))
    out = pairs.join(best, ["query_id", "nth"], "left").join(context.select("query_id", T.value_key("context").alias("body")), "query_id", "left")
    lacking = F.greatest(*((F.length(F.trim(T.text(c))) == 0) for c in ("value", "citation", "metric_hint")))
    held = F.contains(F.coalesce("body", F.lit("")), T.value_key("value"))
    reason = F.when(lacking, "missing_field").when(~held, "value_not_in_context").when(F.col("slot_key").isNull(), "no_matching_slot")
    return out.withColumn("reason", reason).withColumn("slot_key", F.when(reason.isNull(), F.col("slot_key"))).drop("body")


def resolved_missing(required: DataFrame, ledger_missing: DataFrame, flagged: DataFrame, trusted: bool) -> DataFrame:
    """The ledger's missing slots, or with trust the required ones that were flagged."""
    if not trusted:
        return ledger_missing.select("query_id", "slot_key")
    return required.select("query_id", "slot_key").distinct().join(flagged, ["query_id", "slot_key"], "left_semi")


def direct_response(rows: DataFrame) -> DataFrame:
    """rows with action for an answer given without a tool: blocked, insufficient_blocked, rejected or accepted.

    rows: answer, numeric (boolean), n_missing, grounded (boolean).
    """
    action = F.when(F.col("numeric") & (F.col("n_missing") > 0), "blocked").when(T.is_abstain("answer") & (F.col("n_missing") == 0), "insufficient_blocked").when(~F.col("grounded"), "rejected").otherwise("accepted")
    return rows.withColumn("action", action)


def without_citations(c: Column | str) -> Column:
    return T.collapsed(F.regexp_replace(T.text(c), CITATION, ""))


def channel_rows(chunks: DataFrame, channel: str) -> DataFrame:
    """Chunks that a channel can be searched in, with its vector and text (V7); any other name is the body."""
    vector, text = CHANNEL_COLUMNS.get(channel, CHANNEL_COLUMNS["body"])
    return chunks.where(F.col(vector).isNotNull() & F.col(text).isNotNull()).withColumn("channel_vector", F.col(vector)).withColumn("channel_text", F.col(text))


def primary_vectors(chunks: DataFrame) -> DataFrame:
    """Q- vector where there is one, else the body's; chunks with neither go."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return chunks.withColumn("embedding", F.coalesce(some("q_minus_embedding"), some("body_embedding"))).where("embedding is not null")


def sparse_vectors(rows: DataFrame, text: str, vector: str) -> DataFrame:
    """An empty vector where there is no text."""
    return rows.withColumn(vector, F.when(F.length(F.trim(T.text(text))) > 0, F.col(vector)).otherwise(F.array().cast("array<float>")))


def truncated(c: Column | str, tokens: int) -> Column:
    """Text of at most so many tokens at three letters a token."""
    return F.left(T.text(c), F.lit(3 * tokens))


def nodes_by_text(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, place, id: the first node with each text."""
    first = nodes.groupBy("text").agg(F.min("id").alias("id"))
    return texts.join(first, "text").select("query_id", "place", "id")


def unit_sources(units: DataFrame, unit_docs: DataFrame, titles: DataFrame) -> DataFrame:
    """query_id, doc, text of retrieved units by way of their documents (V21); an unknown document keeps its id."""
    u = units.join(unit_docs, "unit_id", "left").join(titles, "doc_id", "left")
    doc = F.regexp_replace(F.coalesce("title", "doc_id", F.lit("")), r"(?i)\.(?:pdf|txt|md|json)$", "")
    return u.select("query_id", doc.alias("doc"), F.lit(0).alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("sent_id"))


def split_variant(c: Column | str) -> Column:
    """struct<strategy, corpus, reflection, agentic> of a variant id, empty where it ends early."""
    p = F.split(T.text(c), "::")
    part = lambda k: F.coalesce(F.get(p, F.lit(k)), F.lit(""))
    return F.struct(part(0).alias("strategy"), part(1).alias("corpus"), part(2).alias("reflection"), F.array_join(F.slice(p, 4, 1 << 30), "::").alias("agentic"))


def seeds(raw: Column | str) -> Column:
    """Whole numbers of a list parted by commas or spaces; anything else is left out."""
    return F.array_compact(F.transform(F.split(T.text(raw), r"[,\s]+"), lambda t: F.when(t.rlike(r"^[-+]?\d+$"), t.try_cast("int"))))


def row_kinds(details: DataFrame) -> DataFrame:
    """details with abstained, failed and is_failure."""
    failed = F.coalesce(F.length(F.col("error")) > 0, F.lit(False)) | F.startswith(F.lower(T.text("answer")), F.lit("@@answer: error"))
    low = F.coalesce(F.col("llm_judge_score") < 1.0, F.lit(False))
    return details.withColumn("abstained", T.is_abstain("answer")).withColumn("failed", failed).withColumn("is_failure", (F.length(T.text("error")) > 0) | low)


def resolved_hallucination(answer: Column | str, judge: Column, reported: Column) -> Column:
    """0 for no answer and abstention, 1 if reported at 0.5 or more, else whether the judge is below 1."""
    a = F.trim(T.text(answer))
    return F.when(T.is_abstain(a) | (F.length(a) == 0), 0.0).when(reported.isNotNull(), (reported >= 0.5).cast("double")).otherwise((F.coalesce(judge, F.lit(0.0)) < 1.0).cast("double"))


def attempted(answer: Column | str, error: Column | str, judge: Column) -> Column:
    """0 for an error, 1 if judged 0.5 or more, else whether the answer does not abstain."""
    return F.when(F.length(T.text(error)) > 0, 0.0).when(judge >= 0.5, 1.0).otherwise((~T.is_abstain(answer)).cast("double"))


def tool_history(calls: DataFrame, outcomes: DataFrame, last: int = 3, letters: int = 700) -> DataFrame:
    """query_id, digest: the last turns with what came of them."""
    j = calls.join(outcomes, ["query_id", "turn"], "left").withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("turn")))).where(F.col("r") <= last)
    line = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(": "), F.col("name"), F.lit(" -> "), F.coalesce("outcome", F.lit("none")))
    d = j.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("digest"))
    return d.withColumn("digest", F.left("digest", F.lit(letters)))


def nodes_filled(nodes: DataFrame, default_k: int, k: int) -> DataFrame:
    """Nodes of an adapter with defaults for missing fields, at most max(default_k, k) a query."""
    n = nodes.select("query_id", "place", F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("sent_id", F.lit(-1)).alias("sent_id"), T.text("text").alias("text"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("place"))).where(F.col("r") <= max(default_k, k)).drop("r")
