"""Answers computed from the ledger: slots bound by period to the places of a formula, evaluated in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seshat.functions import numbers as N
from seshat.functions import text as T
from seshat.functions.periods import year_tokens
from seshat.operators.slots import ledger_matches

PERCENT_UNITS = ("%", "pct", "percents")
FORMULAS = ("growth", "difference", "ratio", "average", "sum", "product")
MOST_PLACES = 8


def formula(kind: Column | str, v: Column) -> Column:
    """The value of a formula over operands in order of period: of the last against the first, or over all; null without one."""
    k = F.col(kind) if isinstance(kind, str) else kind
    first, last, total = F.get(v, F.lit(0)), F.try_element_at(v, F.lit(-1)), F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    pair = F.size(v) >= 2
    out = (
        F.when((k == "growth") & pair, F.try_divide(last - first, first) * 100).when((k == "difference") & pair, last - first).when((k == "ratio") & pair, F.try_divide(last, first))
        .when((k == "average") & (F.size(v) > 0), total / F.size(v)).when((k == "sum") & (F.size(v) > 0), total).when((k == "product") & (F.size(v) > 0), F.aggregate(v, F.lit(1.0), lambda a, x: a * x))
    )
    return F.when(F.forall(v, lambda x: x.isNotNull()), out)


def written(kind: Column | str, shown: Column) -> Column:
    """The formula over operands as they are shown, as a calculator takes it."""
    k = F.col(kind) if isinstance(kind, str) else kind
    first, last = F.get(shown, F.lit(0)), F.try_element_at(shown, F.lit(-1))
    return (
        F.when(k == "growth", F.concat(F.lit("("), last, F.lit(" - "), first, F.lit(") / "), first, F.lit(" * 100"))).when(k == "difference", F.concat(last, F.lit(" - "), first)).when(k == "ratio", F.concat(last, F.lit(" / "), first))
        .when(k == "average", F.concat(F.lit("("), F.array_join(shown, " + "), F.lit(") / "), F.size(shown))).when(k == "sum", F.array_join(shown, " + ")).when(k == "product", F.array_join(shown, " * "))
    )


def rounded(v: Column, places: Column | str) -> Column:
    """A result with so many decimals (0 to 8), or to twelve digits where none are asked for."""
    p = F.col(places) if isinstance(places, str) else places
    out = N.significant(v)
    for k in range(MOST_PLACES + 1):
        out = F.when(p.isNotNull() & (F.greatest(F.lit(0), F.least(p, F.lit(MOST_PLACES))) == k), F.format_string(f"%.{k}f", v)).otherwise(out)
    return F.when(v.isNotNull(), out)


def computed(queries: DataFrame, required: DataFrame, ledger: DataFrame) -> DataFrame:
    """query_id, expression, result, matched, error, answer: computations answered from their ledgers.

    queries: query_id, answer_type, formula, rounding, unit; required: query_id, slot_key, period; ledger: query_id, nth,
    slot_key, value, citation, in_context. Operands are the required slots' values (of several of a slot the first), by
    period and then key. A query is no computation, has missing_slots, or an expression_not_grounded_in_ledger when
    fewer of its numbers than one (two of three slots or more) stand in the ledger's values; no_value when the formula
    has none. The answer bears a percent sign if the unit asks for it, and for each slot in the order of its keys its
    citation, one in the context if there is one; each once.
    """
    usable = ~T.collapsed(F.lower(T.text("value"))).isin("", *T.MISSING_VALUES)
    e = ledger.where(usable)
    values = e.groupBy("query_id", "slot_key").agg(F.min_by("value", "nth").alias("value"))
    cites = ledger.where(F.length(F.trim(T.text("citation"))) > 0).groupBy("query_id", "slot_key").agg(F.coalesce(F.min_by("citation", F.when(F.col("in_context"), F.col("nth"))), F.min_by("citation", "nth")).alias("citation"))
    r = required.join(values, ["query_id", "slot_key"], "left").join(cites, ["query_id", "slot_key"], "left")
    year = F.coalesce(F.get(F.array_sort(year_tokens("period")), F.lit(0)), F.lit(""))
    r = r.withColumn("number", N.primary_number("value"))
    g = r.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count("number").alias("filled"), F.array_sort(F.collect_list(F.struct(year.alias("year"), "slot_key", "number"))).alias("x"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("citation").isNotNull(), F.struct("slot_key", "citation")))), lambda c: c["citation"])).alias("cited"),
    )
    known = e.groupBy("query_id").agg(F.collect_list("value").alias("known"))
    q = queries.where(F.col("answer_type") == "compute").join(g, "query_id", "left").join(known, "query_id", "left")
    q = q.withColumn("operands", F.transform("x", lambda x: x["number"])).withColumn("expression", written("formula", F.transform("operands", N.formatted)))
    q = q.withColumn("value", formula("formula", F.col("operands"))).withColumn("matched", F.coalesce(ledger_matches("expression", F.coalesce("known", F.array().cast("array<string>"))), F.lit(0)))
    least = F.when(F.col("n") >= 3, 2).otherwise(1)
    error = F.when(F.coalesce(F.col("filled") < F.col("n"), F.lit(True)), "missing_slots").when(F.col("matched") < least, "expression_not_grounded_in_ledger").when(F.col("value").isNull(), "no_value")
    percent = F.lower(F.trim(T.text("unit"))).isin(*PERCENT_UNITS) | F.contains(F.lower(T.text("unit")), F.lit("percent"))
    q = q.withColumn("error", error).withColumn("result", F.when(F.col("error").isNull(), rounded(F.col("value"), "rounding")))
    answer = F.concat_ws(" ", F.concat(F.lit("@@ANSWER: "), "result", F.when(percent, "%").otherwise("")), *[F.when(F.size("cited") > 0, F.array_join("cited", " "))])
    return q.select("query_id", F.when(F.col("error").isNull() | (F.col("error") != "missing_slots"), F.col("expression")).alias("expression"), "result", "matched", "error", F.when(F.col("error").isNull(), answer).alias("answer"))


def with_results(answers: DataFrame, results: DataFrame) -> DataFrame:
    """answers with the computed one in place of each that does not state the result.

    answers: query_id, answer; results: those of computed. overridden tells which.
    """
    from seshat.operators.answers import answer_matches_result

    j = answers.join(results.where(F.col("error").isNull()).select("query_id", "result", F.col("answer").alias("_computed")), "query_id", "left")
    wrong = F.col("result").isNotNull() & ~F.coalesce(answer_matches_result("answer", "result"), F.lit(False))
    return j.select(*[c for c in answers.columns if c != "answer"], F.when(wrong, F.col("_computed")).otherwise(F.col("answer")).alias("answer"), wrong.alias("overridden"))
