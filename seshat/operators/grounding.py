"""Whether an answer stands on its evidence: form, policy, citations in the context, and every bound slot cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seshat.functions import text as T
from seshat.operators.evidence import CITATION, boolean_label, first_reason
from seshat.operators.refinement import insufficient, zero_answer


def citation_key(c: Column | str) -> Column:
    return T.collapsed(F.lower(T.text(c)))


def grounded(answers: DataFrame, context: DataFrame, ledger: DataFrame, required: DataFrame) -> DataFrame:
    """answers with grounded and reason, null for those that are grounded.

    answers: query_id, answer, answer_type, policy, n_missing, one row a query; context: query_id, citation; ledger:
    query_id, slot_key, citation; required: query_id, slot_key. Reasons in order: an empty answer, none or several
    prefixes, giving up against the policy or with nothing missing (with slots missing it is grounded), a boolean without
    yes or no, (a zero by policy is grounded), no citations, one that the context lacks (a computation may cite its
    ledger), and a computation that cites none of the citations of a required slot. A query without context is not held
    to it. Citations are compared whatever their case and spaces; those of a query meet those of its own answer alone.
    """
    a = answers.withColumn("_cites", F.transform(F.regexp_extract_all(T.text("answer"), F.lit(CITATION), F.lit(0)), citation_key))
    c = context.select("query_id", citation_key("citation").alias("k")).where("k <> ''").distinct()
    l = ledger.select("query_id", F.trim(T.text("slot_key")).alias("slot_key"), citation_key("citation").alias("k")).where("k <> ''").distinct()  # noqa: E741
    compute = F.col("answer_type") == "compute"
    cited = a.select("query_id", compute.alias("compute"), F.explode(F.array_distinct("_cites")).alias("k"))
    known = c.withColumn("here", F.lit(True))
    entered = l.select("query_id", "k").distinct().withColumn("entered", F.lit(True))
    with_context = c.groupBy("query_id").agg(F.lit(True).alias("_held"))
    outside = cited.join(known, ["query_id", "k"], "left").join(entered, ["query_id", "k"], "left").where(F.col("here").isNull() & ~(F.coalesce("compute", F.lit(False)) & F.col("entered").isNotNull()))
    outside = outside.join(with_context, "query_id", "left_semi").groupBy("query_id").agg(F.min("k").alias("_outside"))
    bound = l.join(required.select("query_id", F.trim(T.text("slot_key")).alias("slot_key")).where("slot_key <> ''").distinct(), ["query_id", "slot_key"], "left_semi")
    bound = bound.join(cited.select("query_id", "k", F.lit(True).alias("hit")), ["query_id", "k"], "left").groupBy("query_id", "slot_key").agg(F.count("hit").alias("hits"))
    uncovered = bound.where("hits = 0").groupBy("query_id").agg(F.min("slot_key").alias("_uncovered"))
    a = a.join(outside, "query_id", "left").join(uncovered, "query_id", "left")
    t, missing = F.trim(T.text("answer")), F.coalesce(F.col("n_missing"), F.lit(0)) > 0
    zero, strict = F.col("policy") == "zero_if_not_explicit", F.col("policy") == "inapplicable_explain"
    gave_up = insufficient(t)
    free = (gave_up & missing) | (zero & missing & zero_answer(t))
    reason = first_reason([
        ("empty final answer", F.length(t) == 0),
        ("missing @@ANSWER prefix", ~F.contains(t, F.lit("@@ANSWER:"))),
        ("multiple @@ANSWER prefixes", F.regexp_count(F.lower(t), F.lit("@@answer:")) > 1),
        ("query policy requires zero when value is not explicitly outlined", gave_up & missing & zero),
        ("query policy requires inapplicable explanation, not insufficient evidence", gave_up & missing & strict),
        ("insufficient evidence despite no missing slots", gave_up & ~missing),
        ("boolean answer must start with yes/no", ~gave_up & (F.col("answer_type") == "boolean") & boolean_label(t).isNull()),
        ("missing inline citations", ~free & (F.size("_cites") == 0)),
        ("citation not present in context", ~free & F.col("_outside").isNotNull()),
        ("missing citation coverage for slot", ~free & compute & F.col("_uncovered").isNotNull()),
    ])
    told = F.when(reason == "citation not present in context", F.concat(reason, F.lit(": "), "_outside")).when(reason == "missing citation coverage for slot", F.concat(reason, F.lit(": "), "_uncovered")).otherwise(reason)
    return a.withColumn("reason", told).withColumn("grounded", reason.isNull()).drop("_cites", "_outside", "_uncovered")
