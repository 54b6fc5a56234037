"""Reports of runs: counters of answers and traces, paired comparisons of systems, and their text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seshat.functions import text as T
from seshat.operators.evaluation import mcnemar

# The metrics that are better the lower they are, and the one that is also compared as right or wrong.
LOWER_IS_BETTER, JUDGED = ("hallucination", "latency", "latency_sec"), "llm_judge_score"
STEPS = {"forced_synthesis": "execution_forced_synthesis", "compute_missing_guard": "execution_compute_missing_guard", "reflection": "reflection", "refinement": "refinement"}
GROUPS, VALUES = 1024, 4096


def run_diagnostics(details: DataFrame, traces: DataFrame) -> DataFrame:
    """The twenty counters and rates of a run's answers and traces, one row.

    details: query_id, answer, error, hallucination, llm_judge_score, one row a query; traces: query_id, step, attempts
    (null where a step does not tell how often it tried: it counts once). A run without queries has zeros.
    """
    gave_up, failed = T.is_abstain("answer"), (F.length(T.text("error")) > 0) | F.startswith(F.lower(T.text("answer")), F.lit("@@answer: error"))
    tried = ~gave_up & ~failed
    known = F.col("hallucination").isNotNull() | F.col("llm_judge_score").isNotNull()
    wrong = F.when(F.col("hallucination").isNotNull(), F.col("hallucination") >= 0.5).otherwise(F.col("llm_judge_score") < 1.0)
    d = details.agg(
        F.count("*").alias("queries"), F.count_if(tried).alias("answer_attempt_count"), F.count_if(tried & F.coalesce(wrong, F.lit(False))).alias("hallucination_count"),
        F.count_if(tried & known).alias("hallucination_eligible_count"), F.count_if(gave_up).alias("insufficient_count"),
    )
    of = lambda name: F.col("step") == STEPS[name]
    own = traces.join(details.select("query_id").distinct(), "query_id", "left_semi")
    attempts = lambda name: F.coalesce(F.sum(F.when(of(name), F.coalesce("attempts", F.lit(1)))), F.lit(0)).alias(f"_{name}")
    t = own.agg(*(F.count_if(of(name)).alias(f"{name}_count") for name in STEPS), attempts("forced_synthesis"), attempts("refinement"))
    per = lambda c, n: F.coalesce(F.try_divide(F.col(c), n), F.lit(0.0))
    every, least = F.col("queries"), lambda c: F.greatest(F.lit(1), F.col(c))
    counted = ["answer_attempt", "hallucination", "insufficient", *STEPS]
    return d.crossJoin(F.broadcast(t)).select(
        "queries", *(F.col(f"{c}_count") for c in counted), "hallucination_eligible_count", *(per(f"{c}_count", every).alias(f"{c}_rate") for c in counted), per("hallucination_count", least("hallucination_eligible_count")).alias("hallucination_rate_answered"),
        per("reflection_count", every).alias("avg_reflection_attempts"), per("_refinement", every).alias("avg_refinement_attempts"), per("_forced_synthesis", least("forced_synthesis_count")).alias("avg_synthesis_attempts"),
    )


def bootstrap_by_counts(pairs: DataFrame, resamples: int = 10_000, seed: int = 13, alpha: float = 0.05) -> DataFrame:
    """mean_difference, low, high: the percentile interval of the mean of b - a, drawn by counts of distinct differences (A10).

    A resample of n rows is a draw of how often each distinct difference is in it, a multinomial over their counts: first
    over groups of differences, then within each, which is the same. So the work follows the distinct differences and not
    the rows. Differences go to as many groups as they need, by hash; a group is drawn in one task. Pairs with a null
    side are left out; without any there are zeros.
    """
    spark = pairs.sparkSession
    d = pairs.select((F.col("b") - F.col("a")).alias("d")).where("d is not null").groupBy("d").agg(F.count("*").alias("c"))
    n, total, kinds = d.agg(F.sum("c"), F.sum(F.col("d") * F.col("c")), F.count("*")).first()
    if not n:
        return spark.createDataFrame([(0.0, 0.0, 0.0)], "mean_difference double, low double, high double")
    groups = max(1, min(GROUPS, kinds // VALUES))
    d = d.withColumn("g", F.pmod(F.xxhash64("d"), F.lit(groups)).cast("int"))
    sizes = np.zeros(groups, np.int64)
    for r in d.groupBy("g").agg(F.sum("c").alias("c")).collect():  # groups are a bounded number
        sizes[r["g"]] = r["c"]
    drawn = spark.sparkContext.broadcast(np.random.default_rng([seed, 0]).multinomial(n, sizes / n, resamples))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, values, counts in _runs(batches):
            rng, p = np.random.default_rng([seed, 1 + g]), counts / counts.sum()
            step = max(1, (1 << 22) // len(values))
            for a in range(0, resamples, step):
                r = np.arange(a, min(resamples, a + step))
                yield pd.DataFrame({"r": r, "s": rng.multinomial(drawn.value[r, g], p) @ values})

    s = d.repartition("g").sortWithinPartitions("g", "d").mapInPandas(sums, "r long, s double").groupBy("r").agg((F.sum("s") / n).alias("m"))
    means = np.sort(s.select("m").toPandas().m.to_numpy())  # a number a resample
    low, high = max(0, int(np.floor(alpha / 2 * resamples))), min(resamples - 1, int(np.ceil((1 - alpha / 2) * resamples)) - 1)
    return spark.createDataFrame([(float(total) / n, float(means[low]), float(means[high]))], "mean_difference double, low double, high double")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """group, differences, counts of each group of rows that arrive sorted by group."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for _, part in batch.groupby("g"):
            if held and held[-1].g.iloc[0] != part.g.iloc[0]:
                whole = pd.concat(held)
                yield int(whole.g.iloc[0]), whole.d.to_numpy(float), whole.c.to_numpy(float)
                held = []
            held.append(part)
    if held:
        whole = pd.concat(held)
        yield int(whole.g.iloc[0]), whole.d.to_numpy(float), whole.c.to_numpy(float)


def paired_metrics(a: DataFrame, b: DataFrame, metrics: list[str], key: str = "query") -> DataFrame:
    """metric, n, mean_a, mean_b, mean_diff, a_wins, b_wins, ties: two systems over the queries that both answered.

    a and b: key, and a column a metric, null where a query has no value; of rows that repeat a key one is taken. Queries
    without a name are left out, metrics without a pair too.
    """
    one = lambda df, s: df.where(F.length(F.trim(T.text(key))) > 0).groupBy(F.trim(key).alias("k")).agg(*(F.max(F.col(m).cast("double")).alias(f"{m}_{s}") for m in metrics))
    j = one(a, "a").join(one(b, "b"), "k")
    long = j.select("k", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b")) for m in metrics))).alias("x")).select("k", "x.*").where("a is not null and b is not null")
    d = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b"))
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("a") - F.col("b")).alias("mean_diff"), F.count_if(d > 0).alias("a_wins"), F.count_if(d < 0).alias("b_wins"), F.count_if(d == 0).alias("ties"))


def paired_report(name_a: str, name_b: str, a: DataFrame, b: DataFrame, metrics: list[str], key: str = "query", resamples: int = 10_000) -> str:
    """The comparison of two systems as text: a line a metric with its interval and wins, and McNemar's test of the judge."""
    found = {r["metric"]: r for r in paired_metrics(a, b, metrics, key).collect()}  # a row a metric
    names = lambda df: df.select(F.trim(key).alias("k")).where("k <> ''").distinct()
    n = names(a).join(names(b), "k").count()
    lines = [f"=== {name_a}  vs  {name_b}    n={n} paired ==="]
    if not found:
        return "\n".join([*lines, "(no overlapping queries)"])
    head = f"{'metric':<20}" + "".join(f"{h:>10}" for h in ("meanA", "meanB", "diff", "CI95_lo", "CI95_hi")) + "".join(f"{h:>6}" for h in ("sig", "A>B", "B>A", "tie"))
    lines += [head, "-" * len(head)]
    pair = lambda m: a.groupBy(F.trim(key).alias("k")).agg(F.max(F.col(m).cast("double")).alias("b")).join(b.groupBy(F.trim(key).alias("k")).agg(F.max(F.col(m).cast("double")).alias("a")), "k").where("k <> '' and a is not null and b is not null")
    for m in metrics:
        if r := found.get(m):
            ci = bootstrap_by_counts(pair(m), resamples).first()
            sig = "*" if ci["low"] > 0 or ci["high"] < 0 else ""
            lines.append(f"{m:<20}{r['mean_a']:>10.4f}{r['mean_b']:>10.4f}{r['mean_diff']:>+10.4f}{ci['low']:>+10.4f}{ci['high']:>+10.4f}{sig:>6}{r['a_wins']:>6d}{r['b_wins']:>6d}{r['ties']:>6d}")
    if JUDGED in found:
        t = mcnemar(pair(JUDGED).select(F.col("b").alias("a"), F.col("a").alias("b")), 0.5).first()
        lines += ["", f"McNemar (judge>=0.5): A_only_correct={t['only_a']}, B_only_correct={t['only_b']}, two-sided p={t['p_value']:.4g}"]
    return "\n".join(lines)
