"""Context atoms: spans with their citations, scored for a query and packed into a budget of letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seshat.functions import text as T
from seshat.functions.periods import year_tokens
from seshat.operators.evidence import CITATION
from seshat.operators.planning import anchor_keywords, entities_match
from seshat.operators.slots import metric_terms

# Letters of an atom and of a context, what lies between two blocks, and words of forecasts.
SPAN_LETTERS, CONTEXT_LETTERS, BETWEEN = 480, 4200, 2
FORECASTS = ("expects", "expected", "approximately", "guidance")
#: Contexts shorter than these are not worth their compression, with slots missing and with a statement asked for.
SHORT, SHORT_ANCHORED = 220, 360


def sentence_atoms(nodes: DataFrame) -> DataFrame:
    """query_id, nth, atom_id, citation, span: each sentence of each node, in order (a stand-in for a model's atoms).

    nodes: query_id, place, title, page, sent_id, text. nth is ordered within a query, not dense.
    """
    s = nodes.select("query_id", "place", T.citation("title", "page", "sent_id").alias("citation"), F.posexplode(T.sentences("text")).alias("at", "span"))
    nth = F.struct("place", "at")
    return s.select("query_id", nth.alias("nth"), F.concat_ws("-", F.lit("a"), "place", "at").alias("atom_id"), "citation", "span")


def sound_atoms(atoms: DataFrame) -> DataFrame:
    """Atoms of a sound citation and a span that is not empty, the first of each id in a query, spans cut."""
    a = atoms.withColumn("citation", F.trim(T.text("citation"))).withColumn("span", F.trim(T.text("span")))
    a = a.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "atom_id").orderBy("nth"))).where("_r = 1").drop("_r")
    return a.where(F.col("citation").rlike(CITATION) & (F.length("span") > 0)).withColumn("span", F.left("span", F.lit(SPAN_LETTERS)))


def _said() -> Column:
    return F.lower(F.concat_ws(" ", "citation", "span"))


def prioritised(atoms: DataFrame, states: DataFrame) -> DataFrame:
    """atoms with priority: 2 for a metric's term, 3 for the statement, 2 for a year, 1 for the company, less for forecasts.

    states: query_id, entity, period, metric, source_anchor, answer_type, slots array<struct<entity, period, metric,
    source_anchor>>. Years are the query's, or where it has none its slots'.
    """
    slots = F.coalesce("slots", F.array().cast("array<struct<entity:string,period:string,metric:string,source_anchor:string>>"))
    every = lambda own, f, of: F.array_distinct(F.concat(f(own), F.flatten(F.transform(slots, lambda s: f(s[of])))))
    years = F.when(F.size(year_tokens("period")) > 0, year_tokens("period")).otherwise(F.array_distinct(F.flatten(F.transform(slots, lambda s: year_tokens(s["period"])))))
    q = states.select("query_id", every(F.col("metric"), metric_terms, "metric").alias("_terms"), every(F.col("source_anchor"), anchor_keywords, "source_anchor").alias("_anchors"), years.alias("_years"), F.lower(F.trim(T.text("entity"))).alias("_entity"), (F.col("answer_type") == "extract").alias("_extract"))
    a = atoms.join(q, "query_id").withColumn("_said", _said())
    holds = lambda c: F.exists(c, lambda t: F.contains(F.col("_said"), t))
    worth = lambda c, n: F.when(c, n).otherwise(0.0)
    score = worth(holds("_terms"), 2.0) + worth(holds("_anchors"), 3.0) + worth(holds("_years"), 2.0) + worth((F.length("_entity") > 0) & F.contains("_said", F.col("_entity")), 1.0)
    score -= worth(F.coalesce("_extract", F.lit(False)) & T.contains_any(F.col("_said"), FORECASTS), 0.5)
    return a.withColumn("priority", score).drop("_terms", "_anchors", "_years", "_entity", "_extract", "_said")


def aligned(atoms: DataFrame, slots: DataFrame) -> DataFrame:
    """atoms with slot_key and alignment: how well each stands for each slot of its query (E20), those of 0 left out.

    slots: query_id, slot_key, entity, period, metric, source_anchor. A slot's metric must be named, and one of its years.
    """
    s = slots.select("query_id", "slot_key", F.filter(metric_terms("metric"), lambda t: F.length(t) >= 3).alias("_terms"), year_tokens("period").alias("_years"), F.filter(anchor_keywords("source_anchor"), lambda t: F.length(t) >= 3).alias("_anchors"), F.trim(T.text("entity")).alias("_entity"))
    a = atoms.join(s, "query_id").withColumn("_said", _said())
    n = lambda c: F.size(F.filter(c, lambda t: F.contains(F.col("_said"), t)))
    company = F.split_part(F.regexp_extract("citation", CITATION, 1), F.lit("_"), F.lit(1))
    a = a.withColumn("_hits", n("_terms")).withColumn("_dated", n("_years")).where((F.col("_hits") > 0) & ((F.size("_years") == 0) | (F.col("_dated") > 0)))
    score = F.least(F.lit(3.0), 1.5 + 0.5 * F.col("_hits")) + F.least(F.lit(2.0), F.col("_dated").cast("double")) + F.when(n("_anchors") > 0, 1.0).otherwise(0.0)
    score += F.when((F.length("_entity") > 0) & (F.length(company) > 0) & entities_match("_entity", company), 1.0).otherwise(0.0)
    return a.withColumn("alignment", score).drop("_terms", "_years", "_anchors", "_entity", "_said", "_hits", "_dated")


def _blocks(atoms: DataFrame) -> DataFrame:
    return atoms.withColumn("_block", F.concat("citation", F.lit("\n"), "span")).withColumn("_size", F.length("_block"))


def packed(atoms: DataFrame, budget: int = CONTEXT_LETTERS, order: list[Column] | None = None, skip: bool = False) -> DataFrame:
    """query_id, atom_ids, context: the atoms of each query, in order, whose blocks fit into the budget.

    The first atom is always taken; then each is, until one does not fit, or with skip, also those behind it that do.
    An atom costs its letters and BETWEEN more. Packing looks at the atoms in their order, but never at all of a
    query's: without skip no more can fit than the budget has letters, and with skip no more of one size than so many
    of them fit, so that the rest are dropped before a query's atoms come together, whatever their number.
    """
    by = order or [F.col("nth")]
    b = _blocks(atoms).withColumn("_key", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(by)))).select("query_id", "atom_id", "_key", "_block", "_size")
    first = W.partitionBy("query_id").orderBy("_key", "atom_id")
    if not skip:
        b = b.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= budget // BETWEEN + 2)
        before = F.coalesce(F.sum(F.col("_size") + BETWEEN).over(first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        b = b.withColumn("_fits", (F.col("_r") == 1) | (before + F.col("_size") <= budget))
        b = b.withColumn("_all", F.min("_fits").over(first.rowsBetween(W.unboundedPreceding, 0))).where("_all")
        g = b.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_r", "atom_id", "_block"))).alias("x"))
        return g.select("query_id", F.transform("x", lambda x: x["atom_id"]).alias("atom_ids"), F.array_join(F.transform("x", lambda x: x["_block"]), "\n\n").alias("context"))
    same = W.partitionBy("query_id", "_size").orderBy("_key", "atom_id")
    # one more of a size than fit: the first atom may be larger than the budget
    b = b.withColumn("_r", F.row_number().over(same)).where((F.col("_r") - 1) * (F.col("_size") + BETWEEN) <= budget)

    def step(a: Column, x: Column) -> Column:
        fits = (F.size(a["ids"]) == 0) | (a["used"] + x["_size"] <= budget)
        taken = F.struct((a["used"] + x["_size"] + BETWEEN).alias("used"), F.array_append(a["ids"], x["atom_id"]).alias("ids"), F.array_append(a["blocks"], x["_block"]).alias("blocks"))
        return F.when(fits, taken).otherwise(a)

    none = F.array().cast("array<string>")
    g = b.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_key", "atom_id", "_size", "_block"))).alias("x"))
    out = g.select("query_id", F.aggregate("x", F.struct(F.lit(0).alias("used"), none.alias("ids"), none.alias("blocks")), step).alias("p"))
    return out.select("query_id", F.col("p.ids").alias("atom_ids"), F.array_join("p.blocks", "\n\n").alias("context"))


def refreshed_context(states: DataFrame, packs: DataFrame, fallback: DataFrame) -> DataFrame:
    """query_id, context, compressed: the packed context where it serves, else the excerpt.

    states: query_id, n_missing, anchored (the question names a statement), cited array<string> of the ledger; packs:
    query_id, context; fallback: query_id, excerpt. A pack is left for the excerpt when slots are missing and it is
    short, when a statement is asked for and it is short, or when it holds none of the citations of the ledger.
    """
    s = states.join(packs, "query_id", "left").join(fallback, "query_id", "left")
    text = F.coalesce("context", F.lit(""))
    here = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    lost = (F.size("cited") > 0) & ~F.arrays_overlap("cited", here)
    use = (F.length(text) > 0) & ~((F.col("n_missing") > 0) & (F.length(text) < SHORT)) & ~(F.col("anchored") & (F.length(text) < SHORT_ANCHORED)) & ~F.coalesce(lost, F.lit(False))
    return s.select("query_id", F.left(F.when(use, text).otherwise(F.coalesce("excerpt", F.lit(""))), F.lit(CONTEXT_LETTERS)).alias("context"), use.alias("compressed"))
