"""Evidence ledgers, slots, citations and answers, as tables keyed by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seshat.functions import text as T
from seshat.functions.numbers import conflict_key
from seshat.functions.periods import year_tokens

SLOT_FIELDS = ("entity", "period", "metric", "source_anchor", "unit", "rounding")
# What names a statement.
ANCHORS = {
    "income statement": ("income statement", "statement of income", "p&l", "profit and loss"),
    "balance sheet": ("balance sheet", "statement of financial position"),
    "cash flow statement": ("cash flow statement", "statement of cash flows", "cash flow"),
    "note table": ("note table",),
}
LAST_NODES, CITATION = 36, r"\[\[(.+?), Page (\d+), Chunk (\d+)\]\]"


def slot_key(slot: Column) -> Column:
    """k=v of the named fields of a slot, in order, joined by |."""
    parts = []
    for f in SLOT_FIELDS:
        v = T.text(source_anchor(slot[f])) if f == "source_anchor" else T.collapsed(F.lower(T.text(slot[f])))
        parts.append(F.when(~v.isin("", "none", "null", "n/a"), F.concat(F.lit(f"{f}="), v)))
    return F.array_join(F.array_compact(F.array(*parts)), "|")


def source_anchor(c: Column | str) -> Column:
    """income statement, balance sheet, cash flow statement or note table; null for none and for several."""
    low = F.lower(F.trim(T.text(c)))
    kinds = [(name, T.contains_any(low, said)) for name, said in ANCHORS.items()]
    hits = sum((k.cast("int") for _, k in kinds), F.lit(0))
    out = F.lit(None).cast("string")
    for name, k in reversed(kinds):
        out = F.when(k, name).otherwise(out)
    return F.when(hits == 1, out)


def _values(ledger: DataFrame, drop_missing: bool) -> DataFrame:
    v = T.collapsed(F.lower(T.text("value")))
    kept = (F.length(v) > 0) & (~v.isin(*T.MISSING_VALUES) if drop_missing else F.lit(True))
    return ledger.where(kept).groupBy("query_id", "slot_key").agg(F.count_distinct(conflict_key(v)).alias("n_values"), F.min(conflict_key(v)).alias("value_key"))


def missing_slots(required: DataFrame, ledger: DataFrame, keep_missing_on_tie: bool = False) -> DataFrame:
    """query_id, slot_key of required slots without a value, or with several where ties stay missing (E5)."""
    j = required.select("query_id", "slot_key").distinct().join(_values(ledger, True), ["query_id", "slot_key"], "left")
    missing = F.col("n_values").isNull()
    return j.where(missing | (F.col("n_values") > 1) if keep_missing_on_tie else missing).select("query_id", "slot_key")


def collapsed_slots(required: DataFrame, ledger: DataFrame) -> DataFrame:
    """query_id, slot_key of slots of one entity, metric and anchor that give one value for several periods.

    required: query_id, slot_key, entity, period, metric, source_anchor.
    """
    years = F.array_join(F.array_sort(year_tokens("period")), ",")
    r = required.select("query_id", "slot_key", years.alias("years"), T.collapsed(F.lower(T.text("entity"))).alias("entity"), T.canonical_metric_key("metric").alias("metric"), F.lower(T.text("source_anchor")).alias("anchor"))
    r = r.where((F.length("years") > 0) & (F.length("metric") > 0)).join(_values(ledger, False), ["query_id", "slot_key"], "left")
    group = ["query_id", "entity", "metric", "anchor"]
    g = r.groupBy(*group).agg(F.count("*").alias("n"), F.count("value_key").alias("filled"), F.count_distinct("years").alias("periods"), F.count_distinct("value_key").alias("kinds"))
    return r.join(g.where("n >= 2 and filled = n and periods >= 2 and kinds = 1"), group, "left_semi").select("query_id", "slot_key")


def merged_ledger(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries take the place of all entries of their slot."""
    return old.join(new.select("query_id", "slot_key").distinct(), ["query_id", "slot_key"], "left_anti").select(*new.columns).unionByName(new)


def best_entries(candidates: DataFrame) -> DataFrame:
    """One entry a slot: the best score, the first of equals by seq."""
    w = W.partitionBy("query_id", "slot_key").orderBy(F.desc("score"), "seq")
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason that holds, in order; null to accept."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(reasons):
        out = F.when(holds, name).otherwise(out)
    return out


def accepted_entries(entries: DataFrame, context: DataFrame) -> DataFrame:
    """entries with the reason they are rejected for, null if none.

    entries: query_id, slot_key, value, citation; context: query_id, citation, span. Checked in order: no slot, no
    value, a value that means missing, no citation, a citation that is not in the context, a value its span lacks.
    """
    from seshat.functions.numbers import value_grounded

    c = context.groupBy("query_id", "citation").agg(F.first("span").alias("span"))
    e = entries.join(c, ["query_id", "citation"], "left")
    value = T.collapsed(F.lower(T.text("value")))
    reasons = [
        ("no_slot", F.length(F.trim(T.text("slot_key"))) == 0),
        ("no_value", F.length(value) == 0),
        ("missing_value", value.isin(*T.MISSING_VALUES)),
        ("no_citation", F.length(F.trim(T.text("citation"))) == 0),
        ("citation_not_in_context", F.col("span").isNull()),
        ("value_not_in_span", ~value_grounded("value", "span")),
    ]
    return e.withColumn("reason", first_reason(reasons)).drop("span")


def last_nodes(rows: DataFrame, by: list[str], identity: str, order: str, most: int = LAST_NODES) -> DataFrame:
    """The last row of each identity, of those the last `most`, in order."""
    r = rows.withColumn("_r", F.row_number().over(W.partitionBy(*by, identity).orderBy(F.desc(order)))).where("_r = 1")
    return r.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_r") <= most).drop("_r")


def within_budget(rows: DataFrame, by: list[str], order: str, content: str, budget: int) -> DataFrame:
    """The first rows whose lengths add up to the budget, one at least."""
    w = W.partitionBy(*by).orderBy(order)
    r = rows.withColumn("used", F.sum(F.length(content)).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(w))
    return r.where((F.col("used") <= budget) | (F.col("_r") == 1)).drop("_r")


def unique_sources(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each doc, page and sent_id."""
    w = W.partitionBy(*by, "doc", "page", "sent_id").orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def within_tool_budget(calls: DataFrame, by: list[str], order: str, budget: str, used: str) -> DataFrame:
    """Calls while some budget remains."""
    w = W.partitionBy(*by).orderBy(order)
    return calls.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col(budget) - F.col(used)).drop("_r")


def citations(rows: DataFrame, by: list[str], answer: str) -> DataFrame:
    """by, title, page, chunk of each citation in a text."""
    found = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(0))
    c = rows.select(*by, F.posexplode(found).alias("nth", "c"))
    return c.select(*by, "nth", F.regexp_extract("c", CITATION, 1).alias("title"), F.regexp_extract("c", CITATION, 2).cast("int").alias("page"), F.regexp_extract("c", CITATION, 3).cast("int").alias("chunk"))


def supported(cited: DataFrame, pool: DataFrame) -> DataFrame:
    """Citations that are in the pool."""
    return cited.join(pool.select("title", "page", "chunk").distinct(), ["title", "page", "chunk"], "left_semi")


def period_nodes(nodes: DataFrame, entity_match: Column, period_match: Column, fail_open: bool, key: str = "query_id") -> DataFrame:
    """Nodes of the entity, of those the ones of the period; with fail_open all of the entity's if none is."""
    n = nodes.where(F.coalesce(entity_match, F.lit(False))).withColumn("_p", F.coalesce(period_match, F.lit(False)))
    if not fail_open:
        return n.where("_p").drop("_p")
    return n.withColumn("_any", F.max("_p").over(W.partitionBy(key))).where("_p or not _any").drop("_p", "_any")


def better_candidates(pairs: DataFrame, rank: list[str]) -> DataFrame:
    """pairs with keep_after: whether the refined answer's ranks are higher, compared in order."""
    before, after = (F.struct(*(F.col(f"{c}_{s}").alias(c) for c in rank)) for s in ("before", "after"))
    return pairs.withColumn("keep_after", after > before)


def unverified_numbers(answers: DataFrame, pool: DataFrame) -> DataFrame:
    """query_id, number: numbers of an answer that no cited chunk holds as text.

    Each answer meets the chunks of its own query.
    """
    bare = lambda c: F.regexp_replace(c, r"[$,\s]", "")
    n = answers.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("answer", CITATION, " "), F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)))).alias("number"))
    hit = n.join(pool.select("query_id", bare("content").alias("body")), "query_id").where(F.contains("body", bare("number"))).select("query_id", "number").distinct()
    return n.join(hit, ["query_id", "number"], "left_anti")


def trace_events(rows: DataFrame) -> DataFrame:
    """query_id, seq, payload: trace fields as a map without nulls, durations to three places (C4)."""
    fields = F.create_map(*(x for c in ("step", "input", "output", "error") for x in (F.lit(c), F.col(c).cast("string"))), F.lit("duration_ms"), F.round("duration_ms", 3).cast("string"))
    return rows.select("query_id", "seq", F.map_filter(fields, lambda k, v: v.isNotNull()).alias("payload"))


def reflected(answers: DataFrame) -> DataFrame:
    """answers with audits of citation, prefix and policy (E27): answer, missing_data_policy."""
    a = T.text("answer")
    zero = (F.col("missing_data_policy") == "zero") & a.rlike(r"(?i)answer\s*:\s*0\b")
    n = F.regexp_count(F.lower(a), F.lit("@@answer:"))
    return answers.select("*", (a.rlike(CITATION) | T.is_abstain("answer") | zero).alias("cited"), (n == 1).alias("one_prefix"), (~T.is_abstain("answer") | F.coalesce(F.col("missing_data_policy") == "insufficient", F.lit(True))).alias("policy_kept"))


def prefixed(answer: Column | str) -> Column:
    """The answer behind one @@ANSWER:."""
    a = F.trim(T.text(answer))
    return F.when(F.startswith(a, F.lit("@@ANSWER:")), a).otherwise(F.concat(F.lit("@@ANSWER: "), a))


def boolean_label(answer: Column | str) -> Column:
    """yes, no or null."""
    low = F.lower(F.trim(F.regexp_replace(F.regexp_replace(T.text(answer), CITATION, " "), r"(?i)@@answer\s*:", " ")))
    return F.when(low.rlike(r"^(?:yes|true)\b"), "yes").when(low.rlike(r"^(?:no|false)\b"), "no")


def tool_calls(rows: DataFrame, by: list[str], response: str) -> DataFrame:
    """by, name, arguments of <tool_call>{...}</tool_call> in a response (E44); calls that are no JSON are left out."""
    c = rows.select(*by, F.posexplode(F.regexp_extract_all(response, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))).alias("nth", "j"))
    return c.select(*by, "nth", F.from_json("j", "name string, arguments string").alias("c")).where("c.name is not null").select(*by, "nth", "c.name", "c.arguments")


def routed_tool(name: Column | str) -> Column:
    """calculator, or graph_search for anything else."""
    return F.when(F.lower(F.trim(T.text(name))) == "calculator", "calculator").otherwise("graph_search")
