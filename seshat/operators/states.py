"""Query states: answer types, anchors, entities, and the spans of context that bear on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seshat.functions import text as T
from seshat.functions.numbers import value_grounded
from seshat.functions.periods import year_tokens
from seshat.operators.answers import missing_data_policy
from seshat.operators.evidence import source_anchor

ANSWER_TYPES = ("extract", "compute", "boolean", "list")
# Words too common to place a metric by.
GENERIC_METRIC_TERMS = ("income", "capital", "assets", "liabilities", "shareholders", "shareowners", "total", "metric")
DEBT_LISTING = ("debt securities", "registered to trade", "national securities exchange", "trading symbol")
NEAR = 120


def answer_type(query: Column | str, given: Column | str) -> Column:
    """The given type; an extraction becomes boolean or list by how the question opens."""
    g, q = F.lower(F.trim(T.text(given))), F.lower(F.trim(T.text(query)))
    g = F.when(g.isin(*ANSWER_TYPES), g).otherwise("extract")
    asks = q.rlike(r"^(?:is|are|was|were|does|do|did|has|have|can|could|should|would)\b")
    lists = q.rlike(r"^(?:which|what are|list|name)\b")
    return F.when((g == "extract") & asks, "boolean").when((g == "extract") & lists, "list").otherwise(g)


def sanitized(states: DataFrame) -> DataFrame:
    """States with normal types, anchors and policies; the entity spreads to slots without one, or comes from them.

    states: query, entity, period, metric, source_anchor, answer_type, missing_data_policy, slots
    array<struct<entity, period, metric, source_anchor>>.
    """
    first = F.get(F.filter(F.transform("slots", lambda s: F.trim(T.text(s["entity"]))), lambda e: F.length(e) > 0), F.lit(0))
    s = states.withColumn("answer_type", answer_type("query", "answer_type")).withColumn("source_anchor", source_anchor("source_anchor"))
    s = s.withColumn("entity", F.when(F.length(F.trim(T.text("entity"))) > 0, F.trim("entity")).otherwise(F.coalesce(first, F.lit(""))))
    policy = missing_data_policy("missing_data_policy")
    s = s.withColumn("missing_data_policy", F.when((F.col("answer_type") == "compute") & (policy == "inapplicable_explain"), "insufficient").otherwise(policy))
    own = lambda x: F.when(F.length(F.trim(T.text(x["entity"]))) > 0, x["entity"]).otherwise(F.col("entity"))
    anchor = lambda x: F.coalesce(source_anchor(x["source_anchor"]), F.col("source_anchor"))
    return s.withColumn("slots", F.transform("slots", lambda x: F.struct(own(x).alias("entity"), x["period"].alias("period"), x["metric"].alias("metric"), anchor(x).alias("source_anchor"))))


def relevant_span(body: Column | str, terms: Column, most: int, compute: Column) -> Column:
    """A text cut to `most` letters around the first term it holds, or from its start."""
    clean = T.collapsed(T.text(body))
    low = F.lower(clean)
    found = F.filter(F.transform(terms, lambda t: F.when(F.length(t) > 0, F.position(t, low))), lambda p: p > 0)
    at = F.get(found, F.lit(0)) - 1
    start = F.greatest(F.lit(0), at - most // 3)
    end = F.least(F.length(clean), start + most)
    start = F.when((end - start < most) & (start > 0), F.greatest(F.lit(0), end - most)).otherwise(start)
    around = F.substr(clean, start + 1, end - start)
    return F.when(F.length(clean) <= most, clean).when(compute | at.isNull(), F.left(clean, F.lit(most))).otherwise(around)


def excerpts(nodes: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, excerpt: the first nodes as citations with their spans.

    nodes: query_id, place, title, page, sent_id, text, terms, answer_type.
    """
    wide = F.col("answer_type").isin("compute", "extract")
    span = F.when(wide, relevant_span("text", F.col("terms"), 1400, F.col("answer_type") == "compute")).otherwise(relevant_span("text", F.col("terms"), 760, F.lit(False)))
    n = nodes.where(F.col("place") <= limit).select("query_id", "place", F.concat(T.citation("title", "page", "sent_id"), F.lit("\n"), span).alias("t"))
    return n.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), "\n\n").alias("excerpt"))


def near_metric_term(value: Column | str, span: Column | str, terms: Column) -> Column:
    """Whether the value stands within NEAR letters of a term (E35): phrases first, common words only if there is nothing else."""
    low = F.lower(T.text(span))
    usable = F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: F.length(t) >= 4)
    generic = F.array(*map(F.lit, GENERIC_METRIC_TERMS))
    phrases, special = F.filter(usable, lambda t: F.contains(t, F.lit(" "))), F.filter(usable, lambda t: ~F.array_contains(generic, t))
    scoped = F.when(F.size(phrases) > 0, F.array_distinct(F.concat(phrases, special))).when(F.size(special) > 0, special).otherwise(usable)
    # a term's windows lie around the cuts that it makes
    def close(t: Column) -> Column:
        parts = F.split(low, F.concat(F.lit("\\Q"), t, F.lit("\\E")))
        windows = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.right(F.get(parts, i - 1), F.lit(NEAR)), t, F.left(F.get(parts, i), F.lit(NEAR))))
        return (F.size(parts) > 1) & F.exists(F.when(F.size(parts) > 1, windows).otherwise(F.array().cast("array<string>")), lambda w: value_grounded(value, w))

    return (F.length(F.trim(T.text(value))) > 0) & F.exists(scoped, close)


def entity_nodes(nodes: DataFrame, fail_open: bool, named: Column | None = None) -> DataFrame:
    """Nodes of the query's entity and period.

    nodes: query_id, title, entity, period, metric. The company is the title up to the first _; the entity must match,
    the period may fail open; listings of debt take any period. `named`: the years of a title, where they are not its
    runs of four digits.
    """
    company, entity = T.normalize_doc_key(F.split_part("title", F.lit("_"), F.lit(1))), T.normalize_doc_key("entity")
    n = nodes.where((F.length(entity) == 0) | ((F.length(company) > 0) & (F.contains(company, entity) | F.contains(entity, company))))
    asked, named = year_tokens("period"), year_tokens("title") if named is None else named
    off = (F.size(asked) > 0) & (F.size(named) > 0) & ~F.arrays_overlap(asked, named)
    listing = T.contains_any(T.canonical_metric_key("metric"), DEBT_LISTING)
    from seshat.operators.evidence import period_nodes

    return period_nodes(n, F.lit(True), listing | ~off, fail_open)
