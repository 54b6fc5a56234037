"""Required slots and the evidence for them: metrics by their names, periods, slot resolution and acceptance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seshat.functions import numbers as N
from seshat.functions import periods as P
from seshat.functions import text as T
from seshat.operators.evidence import ANCHORS, CITATION, first_reason
from seshat.operators.states import near_metric_term

# The words that lead from a metric's name to other names of it.
ALIASES = (
    (("capex", "capital expenditure", "capital expenditures"), ("purchases of property plant and equipment", "purchases of pp&e", "additions to property and equipment", "additions to pp&e")),
    (("cash from operations", "operating cash flow"), ("net cash provided by operating activities", "net cash from operating activities")),
    (("cash & cash equivalents", "cash and cash equivalents"), ("cash and cash equivalents",)),
    (("pp&e", "property and equipment", "property plant and equipment"), ("property and equipment", "property plant and equipment", "property and equipment net", "property plant and equipment net")),
    (("fixed asset turnover", "asset turnover"), ("property and equipment net", "property and equipment - net", "property plant and equipment net", "property plant and equipment - net", "pp&e", "net revenue", "net revenues")),
    (("revenue", "net revenue", "net revenues", "net sales"), ("revenue", "net revenues", "net sales")),
    (("net income attributable to shareholders", "net income attributable to shareowners", "net income attributable to shareowners of the company", "net income attributable to the company"), ("net income", "income attributable to shareholders", "income attributable to shareowners", "income attributable to shareowners of the company")),
    (("adjusted eps", "adjusted earnings per share"), ("adjusted diluted eps", "non-gaap eps", "non-gaap earnings per share")),
    (("total current liabilities", "current liabilities"), ("total current liabilities", "current liabilities")),
    (("capital intensity", "capital-intensive", "capital intensive"), ("capital expenditures", "capex", "purchases of property plant and equipment", "property and equipment net", "fixed assets", "total assets", "return on assets")),
    (("quick ratio",), ("quick ratio", "quick assets", "current assets", "total current assets", "cash and cash equivalents", "marketable securities", "accounts receivable", "total current liabilities", "current liabilities")),
    (("current assets", "total current assets"), ("current assets", "total current assets", "cash and cash equivalents", "marketable securities", "accounts receivable", "inventories", "prepaids", "other current assets")),
    (("current liabilities", "total current liabilities"), ("current liabilities", "total current liabilities", "short-term borrowings", "accounts payable", "other current liabilities")),
    (("segment growth impact", "segment growth", "organic growth"), ("worldwide sales change", "by business segment", "organic sales", "acquisitions", "divestitures", "total sales change", "organic sales growth", "organic local-currency sales", "consumer segment", "segment operating performance", "impact of acquisitions", "impact of divestitures", "impact of m&a")),
    (("debt securities registered to trade", "debt securities", "national securities exchange"), ("trading symbol", "notes due", "new york stock exchange", "registered pursuant to section 12(b)", "section 12(b)", "title of each class", "name of each exchange on which registered", "form 10-q", "cover page")),
    (("operating margin",), ("decrease in gross margin", "sg&a", "combat arms earplugs litigation", "pfas manufacturing", "exiting russia", "divestiture-related restructuring", "special item costs")),
    (("dividend distribution", "dividend stability", "dividend trend"), ("paid dividends since", "consecutive year of dividend increases", "cash dividends declared and paid", "dividend per share")),
)
# What marks capital expenditure, its amounts, and ratios that are not amounts.
CAPEX_RELAXED = ("purchases of property", "capital expenditure", "capital expenditures", "pp&e")
CAPEX_AMOUNTS = ("capital expenditure", "capital expenditures", "purchases of property", "purchases of pp&e", "additions to property and equipment", "additions to pp&e", "property, plant and equipment", "property and equipment")
CAPEX_RATIOS = ("as a percentage", "% of net revenues", "% of net revenue", "% of revenue", "percent of net revenues", "percent of revenue")
# Words that open a question, and small words that may stand inside a name but not end it.
QUESTION_WORDS = ("what", "which", "who", "when", "where", "why", "how", "is", "are", "was", "were", "do", "does", "did", "among", "between", "list", "name")
SMALL_WORDS = ("of", "the", "and", "for", "in", "on", "to", "&")
NAME = r"\b(?:[A-Z][A-Za-z0-9'&.\-]*)(?:\s+(?:[A-Z][A-Za-z0-9'&.\-]*|of|the|and|for|in|on|to|&))*"
YEAR_WINDOW, HINT_WINDOW = 180, 96


def metric_terms(metric: Column | str) -> Column:
    """A metric's name, its canonical key, the names it leads to and its words of four letters or more, each once."""
    low = F.lower(F.trim(T.text(metric)))
    told = [F.when(T.contains_any(low, triggers), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for triggers, names in ALIASES]
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    every = F.concat(F.array(low, T.canonical_metric_key(low)), *told, words)
    return F.array_distinct(F.filter(every, lambda t: F.length(t) > 0))


def metric_matches(a: Column | str, b: Column | str) -> Column:
    """Whether two metrics are one: equal keys, one inside the other, or a name of four letters in common."""
    x, y = T.canonical_metric_key(a), T.canonical_metric_key(b)
    long = lambda c: F.filter(metric_terms(c), lambda t: F.length(t) >= 4)
    return (F.length(x) > 0) & (F.length(y) > 0) & (F.contains(x, y) | F.contains(y, x) | F.arrays_overlap(long(x), long(y)))


def named_entities(query: Column | str) -> Column:
    """Capitalised phrases of a question, each once (F4): without question words before and small words behind them.

    A phrase joined by "and" is two names where both sides have two words or more.
    """
    strip = lambda s: F.regexp_replace(s, r"^[ ,?.!;:()\[\]{}\"']+|[ ,?.!;:()\[\]{}\"']+$", "")
    front = r"(?i)^(?:(?:" + "|".join(QUESTION_WORDS) + r")(?:\s+|$))+"
    back = r"(?i)(?:(?:^|\s+)(?:" + "|".join(SMALL_WORDS) + r"))+$"
    found = F.transform(F.regexp_extract_all(T.text(query), F.lit(NAME), F.lit(0)), lambda m: T.collapsed(F.regexp_replace(F.regexp_replace(T.collapsed(strip(m)), front, ""), back, "")))

    def parts(e: Column) -> Column:
        split = F.filter(F.transform(F.split(e, r"(?i)\band\b"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
        both = F.contains(F.lower(e), F.lit(" and ")) & (F.size(split) >= 2) & F.forall(split, lambda p: F.contains(p, F.lit(" ")))
        return F.when(both, split).otherwise(F.array(e))

    every = F.filter(F.flatten(F.transform(found, parts)), lambda e: F.length(e) > 0)
    keys = F.transform(every, lambda e: F.lower(e))
    return F.filter(every, lambda e, i: F.array_position(keys, F.lower(e)) == i + 1)


def around(span: Column, mark: Column, width: int) -> Column:
    """The stretches of `width` letters on both sides of each place of `mark` in a text."""
    start = lambda at: F.greatest(F.lit(0), at - width)
    return F.transform(T.places(span, mark), lambda at: F.substr(span, start(at) + 1, at + F.length(mark) + width - start(at)))


def value_matches_period(value: Column | str, period: Column | str, title: Column | str, span: Column | str) -> Column:
    """Whether a cited value may belong to a period (D6): by years near it, the title's years, and quarter or annual marks."""
    p, s = F.trim(T.text(period)), T.text(span)
    low = F.lower(s)
    asked, named = P.year_tokens(p), P.year_tokens(title)
    there = F.filter(asked, lambda y: F.contains(low, y))
    aligned = (F.size(there) == 0) | F.exists(there, lambda y: F.exists(around(low, y, YEAR_WINDOW), lambda w: N.value_grounded(value, w)))
    other = (F.size(asked) > 0) & (F.size(named) > 0) & ~F.arrays_overlap(asked, named)
    quarter, annual = T.contains_any(low, P.QUARTER_MARKERS), T.contains_any(low, P.ANNUAL_MARKERS)
    kind = P.granularity(p)
    clash = ((kind == "annual") & quarter & ~annual) | ((kind == "quarter") & annual & ~quarter)
    return (F.length(p) == 0) | (F.length(F.trim(s)) == 0) | (aligned & ~other & ~clash)


def ledger_matches(expression: Column | str, values: Column) -> Column:
    """How many numbers of an expression stand in the ledger, each entry once, the first that is near (M5)."""
    left = F.flatten(F.transform(values, N.numeric_literals))
    near = lambda x, y: F.abs(x - y) <= F.greatest(F.lit(1e-6), F.abs(y) * 1e-4)

    def step(a: Column, x: Column) -> Column:
        at = F.array_position(F.transform(a["left"], lambda y: F.coalesce(near(x, y), F.lit(False))), True).cast("int")
        gone = F.filter(a["left"], lambda y, i: i + 1 != at)
        return F.struct(F.when(at > 0, gone).otherwise(a["left"]).alias("left"), (a["n"] + (at > 0).cast("int")).alias("n"))

    return F.aggregate(N.numeric_literals(expression), F.struct(left.alias("left"), F.lit(0).alias("n")), step)["n"]


CALCULATED = StructType([StructField("result", StringType()), StructField("error", StringType())])


@F.pandas_udf(CALCULATED)
def calculated(expression: pd.Series, precision: pd.Series) -> pd.DataFrame:
    """result and error of a calculator's expression (M2); precision (0 to 8, null: twelve significant digits)."""
    out = []
    for e, p in zip(expression, precision):
        plain = " ".join((e or "").replace(",", "").replace("$", "").replace("%", "").split())
        value = N.evaluate(plain)
        places = None if p is None or pd.isna(p) else max(0, min(int(p), 8))
        if value is None:
            out.append((None, "empty expression" if not (e or "").strip() else "no value"))
        else:
            out.append((f"{value:.12g}" if places is None else f"{round(value, places):.{places}f}", None))
    return pd.DataFrame(out, columns=["result", "error"])


def _entity_matches(a: Column, b: Column) -> Column:
    x, y = T.normalize_doc_key(a), T.normalize_doc_key(b)
    return (F.length(x) == 0) | (F.length(y) == 0) | F.contains(x, y) | F.contains(y, x)


def resolved_slots(entries: DataFrame, required: DataFrame) -> DataFrame:
    """entries with required_key and match: the required slot that each is evidence for.

    entries: query_id, nth (one a query), slot_key, entity, period, metric, source_anchor, value, title, span.
    required: query_id, slot_key, entity, period, metric, source_anchor. An entry takes the slot of its own key; else,
    of the slots that agree in metric, period, entity and anchor, the only one; else the one whose years alone are in
    the title, or alone stand near the value in the span; else the longest key. Without an agreeing slot required_key
    is null and match the commonest reason. Each entry meets the slots of its own query.
    """
    long = lambda c: F.filter(metric_terms(c), lambda t: F.length(t) >= 4)
    # what depends on one side alone is worked out before the sides meet
    r = required.select(
        "query_id", F.col("slot_key").alias("r_key"), T.canonical_metric_key("metric").alias("r_metric"), long("metric").alias("r_terms"), P.year_tokens("period").alias("r_years"), P.quarter_tokens("period").alias("r_quarters"),
        (F.length(F.trim(T.text("period"))) == 0).alias("r_any"), T.normalize_doc_key("entity").alias("r_entity"), F.lower(T.text("source_anchor")).alias("r_anchor"),
    )
    own = entries.select(
        "query_id", "nth", "slot_key", T.canonical_metric_key("metric").alias("metric"), long("metric").alias("terms"), P.year_tokens("period").alias("years"), P.quarter_tokens("period").alias("quarters"), (F.length(F.trim(T.text("period"))) == 0).alias("any"),
        T.normalize_doc_key(F.when(T.is_generic_entity("entity"), "").otherwise(T.text("entity"))).alias("entity"), F.lower(T.text("source_anchor")).alias("anchor"), P.year_tokens("title").alias("titled"), F.lower(T.text("span")).alias("span"), N.scaled_numbers("value").alias("numbers"),
    )
    e = own.join(r, "query_id", "left")
    some, apart = (lambda x, y: (F.size(x) > 0) & (F.size(y) > 0)), (lambda x, y: ~F.arrays_overlap(x, y))
    same_metric = (F.length("metric") > 0) & (F.length("r_metric") > 0) & (F.contains("metric", "r_metric") | F.contains("r_metric", "metric") | F.arrays_overlap("terms", "r_terms"))
    other_period = ~F.col("any") & ~F.col("r_any") & ((some("years", "r_years") & apart("years", "r_years")) | (some("quarters", "r_quarters") & apart("quarters", "r_quarters")))
    reason = first_reason([
        ("metric_mismatch", ~same_metric),
        ("period_mismatch", other_period),
        ("entity_mismatch", (F.length("entity") > 0) & (F.length("r_entity") > 0) & ~F.contains("entity", "r_entity") & ~F.contains("r_entity", "entity")),
        ("anchor_mismatch", (F.length("anchor") > 0) & (F.length("r_anchor") > 0) & (F.col("anchor") != F.col("r_anchor"))),
    ])
    stated = lambda w: F.exists(N.scaled_numbers(w), lambda f: F.exists("numbers", lambda v: F.abs(f - v) <= F.greatest(F.lit(1e-6), F.abs(v) * 1e-4)))
    near = F.exists("r_years", lambda y: F.exists(around(F.col("span"), y, HINT_WINDOW), stated))
    e = e.withColumn("why", reason).select("query_id", "nth", "r_key", (F.col("slot_key") == F.col("r_key")).alias("exact"), "why", F.arrays_overlap("r_years", "titled").alias("titled"), F.when(F.col("why").isNull() & F.col("r_key").isNotNull(), near).alias("near"))
    fits = F.col("why").isNull() & F.col("r_key").isNotNull()
    key = lambda c: F.min(F.when(fits & c, F.col("r_key")))
    n = lambda c: F.count_if(fits & c)
    longest = F.max_by("r_key", F.when(fits, F.struct(F.length("r_key"), F.col("r_key"))))
    whys = ("metric_mismatch", "period_mismatch", "entity_mismatch", "anchor_mismatch")
    g = e.groupBy("query_id", "nth").agg(
        F.min(F.when(F.col("exact"), F.col("r_key"))).alias("exact"), n(F.lit(True)).alias("n"), key(F.lit(True)).alias("one"), n(F.col("titled")).alias("n_titled"), key(F.col("titled")).alias("titled"),
        n(F.col("near")).alias("n_near"), key(F.col("near")).alias("near"), longest.alias("longest"), *(F.count_if(F.col("why") == w).alias(w) for w in whys),
    )
    most = F.greatest(*map(F.col, whys))
    commonest = F.lit("slot_unmatched")
    for w in reversed(whys):
        commonest = F.when((F.col(w) == most) & (most > 0), w).otherwise(commonest)
    hinted = F.when(F.col("n_titled") == 1, F.col("titled")).when(F.col("n_near") == 1, F.col("near"))
    chosen = F.coalesce("exact", F.when(F.col("n") == 1, F.col("one")).when(F.col("n") > 1, F.coalesce(hinted, F.col("longest"))))
    how = F.when(F.col("exact").isNotNull(), "exact_slot_match").when(F.col("n") == 1, "structural_slot_match").when((F.col("n") > 1) & hinted.isNotNull(), "structural_slot_tiebreak_year_hint").when(F.col("n") > 1, "structural_slot_tiebreak").otherwise(commonest)
    return entries.join(g.select("query_id", "nth", chosen.alias("required_key"), how.alias("match")), ["query_id", "nth"])


def acceptance(entries: DataFrame) -> DataFrame:
    """entries with the first reason for which each is rejected, null for those that are accepted, and value_key.

    entries: query_id, nth, slot_key, value, citation (as cited), span (of the cited chunk, null if the context lacks
    it), required_key and match of resolved_slots, the required slot's entity, period, metric, source_anchor (r_*),
    and the query's answer_type and anchor. Reasons are tried in the order of the list; what passes them all is a
    duplicate if an earlier entry of its slot has its value and citation, repeats the slot's value, or is in conflict
    with it.
    """
    value, title = T.collapsed(F.lower(T.text("value"))), F.regexp_extract(T.text("citation"), CITATION, 1)
    span, low = T.text("span"), F.lower(T.text("span"))
    key, capex = T.canonical_metric_key("r_metric"), T.metric_class("r_metric") == "capex"
    anchor = F.coalesce(F.when(F.length(T.text("r_source_anchor")) > 0, F.lower("r_source_anchor")), F.lower(T.text("anchor")))
    compute, has = F.col("answer_type") == "compute", F.length(span) > 0
    grounded = ~has | N.value_grounded("value", "span")
    relaxed = capex & (anchor == "cash flow statement") & span.rlike(r"\d") & T.contains_any(low, CAPEX_RELAXED)
    asked, named = P.year_tokens("r_period"), P.year_tokens(title)
    terms = F.slice(F.filter(metric_terms("r_metric"), lambda t: F.length(t) >= 4), 1, 12)
    blob = F.concat_ws(" ", F.lower(T.text("citation")), low)
    cash = anchor == "cash flow statement"
    paid = (T.metric_class("r_metric") == "dividend") & F.contains(low, F.lit("dividend"))
    reasons = [
        ("missing_slot", F.length(F.trim(T.text("slot_key"))) == 0),
        ("missing_value", F.length(value) == 0),
        ("missing_citation", F.length(F.trim(T.text("citation"))) == 0),
        ("invalid_citation_format", ~T.text("citation").rlike(CITATION)),
        ("citation_not_in_context", F.col("span").isNull()),
        ("unresolved", F.col("required_key").isNull()),
        ("entity_mismatch", (F.length(title) > 0) & ~_entity_matches(T.text("r_entity"), F.split_part(title, F.lit("_"), F.lit(1)))),
        ("citation_period_mismatch", ~compute & (F.size(asked) > 0) & (F.size(named) > 0) & ~F.arrays_overlap(asked, named)),
        ("value_period_mismatch", grounded & ~value_matches_period("value", "r_period", title, "span")),
        ("value_not_in_cited_span", ~grounded & ~relaxed),
        ("value_not_near_metric_term", compute & has & (F.size(terms) > 0) & ~capex & ~near_metric_term("value", "span", terms)),
        ("percent_value_for_amount_slot", ~T.contains_any(key, T.RATIO_MARKERS) & (F.contains(value, F.lit("%")) | F.contains(value, F.lit("percent")))),
        ("source_anchor_mismatch", cash & ~paid & ~T.contains_any(blob, ANCHORS["cash flow statement"])),
        ("capex_marker_missing", capex & cash & ~T.contains_any(low, CAPEX_AMOUNTS)),
        ("capex_ratio_span", capex & cash & T.contains_any(low, CAPEX_RATIOS)),
        ("placeholder_value", value.isin(*T.MISSING_VALUES)),
    ]
    first = first_reason(reasons)
    told = F.when(first == "unresolved", F.col("match")).otherwise(first)
    paid_out = F.when(capex & cash, N.positive_amount("value")).otherwise(F.col("value"))
    e = entries.withColumn("reason", told).withColumn("value_key", N.conflict_key(paid_out))
    same = W.partitionBy("query_id", "required_key", "value_key", "citation", F.col("reason").isNull()).orderBy("nth")
    slot = W.partitionBy("query_id", "required_key", F.col("reason").isNull()).orderBy("nth")
    late = F.when(F.row_number().over(same) > 1, "duplicate_slot_candidate").when(F.first("value_key").over(slot) == F.col("value_key"), F.when(F.row_number().over(slot) > 1, "duplicate_slot_same_value")).otherwise("slot_conflict_best_supported")
    return e.withColumn("reason", F.coalesce("reason", late))
