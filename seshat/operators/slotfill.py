"""Slots filled from the text itself: windows around the names of a metric and the years of a period, scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seshat.functions import numbers as N
from seshat.functions import periods as P
from seshat.functions import text as T
from seshat.operators.slots import CAPEX_AMOUNTS, CAPEX_RATIOS, metric_terms

# Phrases that only the statement itself bears.
STRICT_ANCHORS = {
    "cash flow statement": ("cash flow statement", "statement of cash flows", "consolidated statement of cash flows", "cash flows from operating activities", "cash flows from investing activities", "cash flows from financing activities", "net cash provided by operating activities", "net cash provided by investing activities", "net cash used in financing activities", "net increase (decrease) in cash and cash equivalents", "purchases of property, plant and equipment", "purchases of pp&e"),
    "income statement": ("income statement", "statement of income", "statement of operations", "consolidated statements of operations", "consolidated statement of income"),
    "balance sheet": ("balance sheet", "statement of financial position", "consolidated balance sheets", "consolidated balance sheet"),
}
# Letters of a window before and behind a term and a year, and metrics that are no small numbers.
AROUND_TERM, AROUND_YEAR = (36, 140), (24, 110)
LARGE_METRICS, LEAST_LARGE = ("revenue", "net sales", "net revenues", "total assets"), 100.0
#: Terms of a metric that are looked for, and those of them that windows are cut around.
COUNTED, CUT = 16, 10


def window(text: Column, at: Column, size: Column, around: tuple[int, int]) -> Column:
    start = F.greatest(F.lit(0), at - around[0])
    return F.substr(text, start + 1, at + size + around[1] - start)


def anchored(anchor: Column, said: Column) -> Column:
    """Whether a text names the statement; true for an anchor that no phrase stands for."""
    out = F.lit(True)
    for name, phrases in STRICT_ANCHORS.items():
        out = F.when(anchor == name, T.contains_any(said, phrases)).otherwise(out)
    return out


def _named(anchor: Column, low: Column) -> Column:
    """Whether a text holds the anchor or one of its words of three letters or more."""
    words = F.filter(F.array_append(F.split(anchor, "[^a-z0-9]+"), anchor), lambda w: F.length(w) >= 3)
    return F.exists(words, lambda w: F.contains(low, w))


def candidate_windows(slots: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each window of a node that may hold a slot's value, and one without a window for each node.

    Columns: query_id, slot_key, capex, large, place, title, page, sent_id, score (but for the window), most (the
    node's largest number), whole (its primary one), nth (the window's place in the order of trial; null for none), w.
    A node takes part when it names the metric (if it has a name), does not speak of other years only, and fits the
    slot's statement. Nodes and slots meet within their query.
    """
    s = slots.select(
        "query_id", "slot_key", F.lower(F.trim(T.text("source_anchor"))).alias("anchor"), P.year_tokens(F.trim(T.text("period"))).alias("asked"), T.canonical_metric_key("metric").alias("key"),
        F.slice(F.filter(metric_terms("metric"), lambda t: F.length(t) >= 4), 1, COUNTED).alias("terms"), T.metric_class("metric").alias("kind"),
    )
    s = s.withColumn("capex", (F.col("kind") == "capex") & (F.col("anchor") == "cash flow statement")).withColumn("large", T.contains_any(F.col("key"), LARGE_METRICS)).drop("kind", "key")
    n = nodes.select("query_id", "place", "title", "page", "sent_id", T.collapsed(T.text("text")).alias("body")).where(F.length("body") > 0)
    # what does not depend on the slot is computed once a node
    n = n.withColumn("low", F.lower("body")).withColumn("said", P.year_tokens("body")).withColumn("named", P.year_tokens("title")).withColumn("most", N.largest_non_year("body")).withColumn("whole", N.primary_number("body"))
    j = n.join(s, "query_id")
    some = lambda c: F.size(c) > 0
    in_text, in_title = F.arrays_overlap("asked", "said"), F.arrays_overlap("asked", "named")
    off = F.when(some("said"), ~in_text).otherwise(some("named") & ~in_title)
    j = j.where(~(some("asked") & off)).where(~F.col("capex") | (T.contains_any(F.col("low"), CAPEX_AMOUNTS) & ~T.contains_any(F.col("low"), CAPEX_RATIOS)))
    j = j.withColumn("hits", F.size(F.filter("terms", lambda t: F.contains(F.col("low"), t)))).where((F.col("hits") > 0) | (F.size("terms") == 0))
    cited = F.concat_ws(" ", F.lower(T.citation("title", "page", "sent_id")), "low")
    sheet = F.col("anchor").isin("income statement", "balance sheet")
    years = some("asked") & F.when(some("said"), in_text).otherwise(False)
    titled = some("asked") & some("named") & in_title
    j = j.where(anchored(F.col("anchor"), cited) | (sheet & (_named(F.col("anchor"), F.col("low")) | ((F.col("hits") > 0) & (years | titled | ~some("asked"))))))
    by_year = F.when(years, 4).when(titled, 1).when(some("asked") & ~some("said") & ~some("named"), 1).otherwise(0)
    score = F.col("hits") * 2 + by_year + (F.length("anchor") > 0).cast("int")
    cut = lambda marks, text, around, kind: F.transform(marks, lambda m, i: F.transform(T.places(text, m), lambda at: F.struct(F.lit(kind).alias("kind"), i.alias("i"), at.alias("at"), F.length(m).alias("size"))))
    hits = F.concat(F.flatten(cut(F.slice("terms", 1, CUT), F.col("low"), AROUND_TERM, 0)), F.flatten(cut(F.col("asked"), F.col("body"), AROUND_YEAR, 1)))
    j = j.select("query_id", "slot_key", "capex", "large", "place", "title", "page", "sent_id", score.alias("score"), "most", "whole", "body", F.posexplode_outer(hits).alias("nth", "h"))
    at, size = F.col("h.at"), F.col("h.size")
    w = F.when(F.col("h.kind") == 0, window(F.col("body"), at, size, AROUND_TERM)).otherwise(window(F.col("body"), at, size, AROUND_YEAR))
    return j.select("query_id", "slot_key", "capex", "large", "place", "title", "page", "sent_id", "score", "most", "whole", "nth", w.alias("w"))


def filled_slots(slots: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, slot_key, value, citation, score: the best value that the nodes of a query hold for each slot.

    slots: query_id, slot_key, period, metric, source_anchor, those of computations that are still missing, one row a
    query and key; nodes: query_id, place (their order, one row each), title, page, sent_id, text. A node's value is the
    first number of its windows that is no year (and no small one where the metric is a large amount: then the node's
    largest number stands for it), or without any window of a number the node's own primary number, which counts two
    less. The node of the best score gives the slot's value, the first of equals. Slots without a value are left out,
    null texts count as empty. Nodes and slots are dealt by query once; a node's windows are counted where it lies.
    """
    c = candidate_windows(slots, nodes).withColumn("v", F.when(~F.col("capex") | ~T.contains_any(F.lower("w"), CAPEX_RATIOS), N.primary_number("w")))

    def usable(v: Column) -> Column:
        """The value as it is taken, null where it is passed over."""
        year = (F.abs(v) == F.floor(F.abs(v))) & F.abs(v).between(1900, 2100)
        small = F.col("large") & (F.abs(v) < LEAST_LARGE)
        return F.when(v.isNotNull() & ~year, F.when(small, F.when(F.abs(F.col("most")) >= LEAST_LARGE, F.col("most"))).otherwise(v))

    own = ["query_id", "slot_key", "place"]
    one = ["title", "page", "sent_id", "score", "capex"]
    g = c.groupBy(*own).agg(*(F.first(x).alias(x) for x in one), F.count("v").alias("n"), F.min_by(usable(F.col("v")), F.when(usable(F.col("v")).isNotNull(), F.col("nth"))).alias("near"), F.first(usable(F.col("whole"))).alias("far"))
    g = g.withColumn("value", F.when(F.col("n") > 0, F.col("near")).otherwise(F.col("far"))).where(F.col("value").isNotNull())
    g = g.withColumn("score", F.col("score") + F.when(F.col("n") > 0, 2).otherwise(0))
    shown = N.formatted(F.col("value"))
    g = g.select("query_id", "slot_key", "place", "score", F.when(F.col("capex"), N.positive_amount(shown)).otherwise(shown).alias("value"), T.citation("title", "page", "sent_id").alias("citation"))
    best = F.max_by(F.struct("value", "citation", "score"), F.struct("score", -F.col("place")))
    return g.groupBy("query_id", "slot_key").agg(best.alias("b")).select("query_id", "slot_key", "b.value", "b.citation", "b.score")
