"""Refinement of answers round by round: what still needs it, what is kept, and when it has come to rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seshat.functions import text as T
from seshat.operators.checks import is_unfixable
from seshat.operators.evidence import CITATION

# Phrases for an answer that gives up, for a zero by policy, and for evidence of another company.
INSUFFICIENT = ("insufficient evidence", "cannot be determined", "not possible to determine", "cannot answer with the available", "does not contain", "not available in the context")
ZERO_ANSWERS = ("@@answer: 0", "@@answer: 0.0", "@@answer: 0.00")
GIVEN_UP = "@@ANSWER: insufficient evidence"
ENTITY_PHRASES = ("entity mismatch", "entity/period mismatch", "cross-company", "cross-entity", "wrong entity", "different entity", "different company", "unrelated to", "is unrelated", "are unrelated", "not match the query_state entity", "does not match the query", "cross-company/year", "fabricated citation", "hallucinated")
ENTITY_CODE = r"(?<![a-z0-9])c(?:1|8)(?:/c?[0-9])?(?![a-z0-9])"
KEPT = ("answer", "critique", "arithmetic", "issues", "passed", "grounded")


def insufficient(answer: Column | str) -> Column:
    return T.contains_any(F.lower(T.text(answer)), INSUFFICIENT)


def entity_issue(issues: Column) -> Column:
    """Whether a reflection names evidence of another company or period."""
    low = F.transform(F.coalesce(issues, F.array().cast("array<string>")), lambda i: F.lower(T.text(i)))
    return F.exists(low, lambda i: T.contains_any(i, ENTITY_PHRASES) | i.rlike(ENTITY_CODE))


def cited(answer: Column, policy: Column, n_missing: Column, zero: Column) -> Column:
    """Whether an answer bears a citation, or may do without: a zero by policy while slots are missing."""
    return T.text(answer).rlike(CITATION) | ((policy == "zero_if_not_explicit") & (n_missing > 0) & zero)


def zero_answer(answer: Column | str) -> Column:
    return T.collapsed(F.lower(F.regexp_replace(T.text(answer), CITATION, ""))).isin(*ZERO_ANSWERS)


def one_prefix(answer: Column | str) -> Column:
    a = T.text(answer)
    return F.contains(a, F.lit("@@ANSWER:")) & (F.regexp_count(F.lower(a), F.lit("@@answer:")) <= 1)


def needs_structure(answer: Column, policy: Column, n_missing: Column) -> Column:
    """Whether an answer's form alone calls for refinement."""
    a = T.text(answer)
    return (F.length(F.trim(a)) == 0) | ~one_prefix(a) | (insufficient(a) & (n_missing == 0)) | ~cited(a, policy, n_missing, zero_answer(a))


def rank(s: Column, policy: Column, n_missing: Column) -> Column:
    """The seven places by which two answers are compared."""
    arithmetic = F.lower(F.trim(F.coalesce(s["arithmetic"], F.lit("na"))))
    issues = F.size(F.filter(F.coalesce(s["issues"], F.array().cast("array<string>")), lambda i: F.length(F.trim(T.text(i))) > 0))
    places = (
        F.coalesce(s["passed"], F.lit(False)).cast("int"), F.coalesce(s["grounded"], F.lit(False)).cast("int"), (~insufficient(s["answer"])).cast("int"), -issues,
        F.when(arithmetic.isin("ok"), 2).when(arithmetic.isin("na", ""), 1).otherwise(0), cited(s["answer"], policy, n_missing, zero_answer(s["answer"])).cast("int"), one_prefix(s["answer"]).cast("int"),
    )
    return F.struct(*(p.alias(f"p{i}") for i, p in enumerate(places)))


def preferred(before: Column, after: Column, policy: Column, n_missing: Column) -> tuple[Column, Column]:
    """Whether the refined answer is kept, and why (E28): giving up seldom takes the place of an answer, ranks decide the rest."""
    b, a = rank(before, policy, n_missing), rank(after, policy, n_missing)
    gave_up, recovers = ~insufficient(before["answer"]) & insufficient(after["answer"]), insufficient(before["answer"]) & ~insufficient(after["answer"])
    failed = ~F.coalesce(before["passed"], F.lit(False))
    foreign, strict = failed & entity_issue(before["issues"]), policy.isin("inapplicable_explain", "zero_if_not_explicit")
    fewer = failed & ~F.coalesce(after["passed"], F.lit(False)) & (-a["p3"] < -b["p3"])
    tail = lambda r: F.struct(*(r[f"p{i}"] for i in range(2, 7)))
    why = (
        F.when(gave_up & foreign, "prefer_insufficient_over_entity_mismatched_grounded").when(gave_up & strict, "policy_disallows_insufficient_after_grounded_answer")
        .when(gave_up & fewer, "issue_count_improved_on_insufficient_rollback").when(gave_up, "non_regression_guard_before_grounded_after_insufficient")
        .when(recovers & T.text(after["answer"]).rlike(CITATION), "prefer_cited_over_insufficient").when(recovers & (tail(a) > tail(b)), "prefer_substantive_over_insufficient")
        .when(recovers, "rank_comparison_no_grounded").otherwise("rank_comparison")
    )
    keep = F.when(gave_up, foreign | (~strict & fewer)).when(recovers, T.text(after["answer"]).rlike(CITATION) | (tail(a) > tail(b))).otherwise(a > b)
    return keep, why


def signature(s: Column) -> Column:
    """What tells a state from the next: answer, critique, arithmetic and issues, whatever their case and spaces."""
    flat = lambda c: T.collapsed(F.lower(T.text(c)))
    issues = F.filter(F.transform(F.coalesce(s["issues"], F.array().cast("array<string>")), flat), lambda i: F.length(i) > 0)
    return F.struct(flat(s["answer"]).alias("answer"), flat(s["critique"]).alias("critique"), flat(F.coalesce(s["arithmetic"], F.lit("na"))).alias("arithmetic"), issues.alias("issues"))


def refined(drafts: DataFrame, candidates: DataFrame, rounds: int = 2, rejudge: bool = False) -> DataFrame:
    """query_id, answer, passed, n_rounds, outcome: drafts refined until they need no more or come to rest.

    drafts: query_id, answer, critique, arithmetic, issues array<string>, passed, grounded, policy, n_missing, one row a
    query; candidates: query_id, round (from 1), and the same down to grounded: what a round would make of the answer.
    A round meets only the queries whose reflection failed or whose form is unsound; it keeps the refined answer or goes
    back, and a state equal to the one before ends the loop, as does a round without a candidate. An answer that had
    citations keeps them when its refinement bears none. Without rejudge a refined answer is judged as the one before.
    A defect that no round repairs leaves an answer that gives up. Each round is cut from the lineage of the last where
    the session has a folder for it, and joins the open queries alone.
    """
    s = drafts.select("query_id", "policy", "n_missing", F.struct(*KEPT).alias("s"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("outcome"))
    policy, missing = F.coalesce("policy", F.lit("insufficient")), F.coalesce("n_missing", F.lit(0))
    for k in range(1, rounds + 1):
        need = ~F.coalesce(F.col("s.passed"), F.lit(False)) | needs_structure(F.col("s.answer"), policy, missing)
        s = s.withColumn("outcome", F.when(F.col("outcome").isNull() & ~need, "sound").otherwise(F.col("outcome")))
        c = candidates.where(F.col("round") == k).select("query_id", F.struct(*KEPT).alias("c"))
        going = s.where("outcome is null").join(c, "query_id", "left")
        before = F.regexp_extract_all(T.text(F.col("s.answer")), F.lit(CITATION), F.lit(0))
        lost = (F.size(before) > 0) & ~T.text(F.col("c.answer")).rlike(CITATION)
        kept = F.when(F.length(F.trim(T.text(F.col("c.answer")))) > 0, F.when(lost, F.concat(F.rtrim("c.answer"), F.lit(" "), F.array_join(before, " "))).otherwise(F.col("c.answer"))).otherwise(F.col("s.answer"))
        judged = {x: F.col(f"c.{x}") for x in KEPT} if rejudge else {x: F.col(f"s.{x}") for x in KEPT} | {"grounded": F.coalesce("c.grounded", "s.grounded")}
        after = F.struct(*((kept if x == "answer" else F.coalesce(judged[x], F.col(f"s.{x}")) if x != "issues" else F.coalesce(judged[x], F.col("s.issues"))).alias(x) for x in KEPT))
        going = going.withColumn("a", F.when(F.col("c").isNotNull(), after).otherwise(F.col("s")))
        going = going.withColumn("t", F.when(preferred(F.col("s"), F.col("a"), policy, missing)[0], F.col("a")).otherwise(F.col("s")))
        rests = signature(F.col("s")) == signature(F.col("t"))
        going = going.select("query_id", "policy", "n_missing", F.col("t").alias("s"), F.lit(k).alias("n"), F.when(rests, "at rest").alias("outcome"))
        s = s.where("outcome is not null").unionByName(going)
        if s.sparkSession.sparkContext.getCheckpointDir() is not None:
            s = s.checkpoint()
    failed = ~F.coalesce(F.col("s.passed"), F.lit(False)) & (is_unfixable("s.arithmetic", F.col("s.issues")) | entity_issue(F.col("s.issues")))
    ends = failed & ((F.col("outcome") == "at rest") | ~insufficient("s.answer"))
    outcome = F.when(F.coalesce(ends, F.lit(False)), "given up").otherwise(F.coalesce("outcome", F.lit("rounds spent")))
    return s.select("query_id", F.when(outcome == "given up", GIVEN_UP).otherwise(F.col("s.answer")).alias("answer"), F.coalesce("s.passed", F.lit(False)).alias("passed"), F.col("n").alias("n_rounds"), outcome.alias("outcome"))
