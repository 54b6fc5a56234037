"""Scores of runs: means, labels, intervals, comparisons, leaderboards and coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seshat.functions import text as T
from seshat.operators.draws import drawn as draws
from seshat.operators.ordering import ranked

Z95 = 1.96
#: Differences of a bootstrap that are sent to every task, and draws of one task.
MOST_LOOKED_UP, DRAWS = 1 << 22, 20_000_000


def means(results: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """n and the mean of each metric, overall or by group; nulls do not count (A1, A2)."""
    return results.groupBy(*(by or [])).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))


def rollup_means(results: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Means of each group, of groups of groups and overall in one pass; nulls in the group columns stand for all."""
    return results.rollup(*by).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))


def label_counts(results: DataFrame, label: Column) -> DataFrame:
    """n, and count and rate of each of three answer labels (A3)."""
    named = {"correct": "Correct Answer", "refusal": "Refusal", "incorrect": "Incorrect Answer"}
    c = results.select(label.alias("l")).agg(F.count("*").alias("n"), *(F.count_if(F.col("l") == v).alias(k) for k, v in named.items()))
    return c.select("*", *((F.col(k) / F.greatest(F.lit(1), F.col("n"))).alias(f"{k}_rate") for k in named))


def seed_intervals(summaries: DataFrame, by: list[str], metric: str) -> DataFrame:
    """mean, std (n - 1), low and high of a metric over seeds; one seed has no width (A4)."""
    g = summaries.groupBy(*by).agg(F.count("*").alias("n_seeds"), F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"))
    half = F.when(F.col("n_seeds") > 1, Z95 * F.col("std") / F.sqrt("n_seeds")).otherwise(0.0)
    return g.select(*by, "n_seeds", "mean", "std", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def in_all_seeds(summaries: DataFrame, category: str, seed: str) -> DataFrame:
    """Rows of the categories that every seed has (A5)."""
    n = summaries.agg(F.count_distinct(seed).alias("every"))
    full = summaries.groupBy(category).agg(F.count_distinct(seed).alias("n")).crossJoin(F.broadcast(n)).where("n = every").select(category)
    return summaries.join(full, category, "left_semi")


def hallucination_stats(details: DataFrame) -> DataFrame:
    """Attempts and hallucinations over answer, error, hallucination, llm_judge_score."""
    failed = F.coalesce(F.length(F.col("error")) > 0, F.lit(False)) | F.startswith(F.lower(T.text("answer")), F.lit("@@answer: error"))
    tried = ~T.is_abstain("answer") & ~failed
    wrong = F.when(F.col("hallucination").isNotNull(), F.col("hallucination") >= 0.5).when(F.col("llm_judge_score").isNotNull(), F.col("llm_judge_score") < 1.0)
    d = details.select(tried.alias("t"), wrong.alias("w"))
    s = d.agg(F.count("*").alias("total"), F.count_if("t").alias("answer_attempt_count"), F.count_if(F.col("t") & F.coalesce("w", F.lit(False))).alias("hallucination_count"), F.count_if(F.col("t") & F.col("w").isNotNull()).alias("hallucination_eligible_count"))
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return s.select("answer_attempt_count", "hallucination_count", "hallucination_eligible_count", share("answer_attempt_count", "total").alias("answer_attempt_rate"), share("hallucination_count", "total").alias("hallucination_rate"), share("hallucination_count", "hallucination_eligible_count").alias("hallucination_rate_answered"))


def stage_diagnostics(traces: DataFrame, query: str, step: str, duration: str) -> DataFrame:
    """For each step: events, queries it is in, their share, events a query, mean and total duration."""
    per = traces.groupBy(query, step).agg(F.count("*").alias("events"), F.sum(duration).alias("total"))
    every = traces.agg(F.count_distinct(query).alias("every"))
    out = per.groupBy(step).agg(F.sum("events").alias("events"), F.count("*").alias("queries"), F.sum("total").alias("total_duration"))
    return out.crossJoin(F.broadcast(every)).select(step, "events", "queries", (F.col("queries") / F.col("every")).alias("query_rate"), (F.col("events") / F.col("queries")).alias("events_per_query"), (F.col("total_duration") / F.col("events")).alias("mean_duration"), "total_duration")


def paired(a: DataFrame, b: DataFrame, key: str, metric: str, order: str | None = None) -> DataFrame:
    """key, a, b of queries in both runs; of repeated rows the last of b and the first of a in `order`."""
    o = order or metric
    x = a.groupBy(key).agg(F.min_by(metric, F.struct(o, metric)).alias("a"))
    y = b.groupBy(key).agg(F.max_by(metric, F.struct(o, metric)).alias("b"))
    return x.join(y, key)


def win_loss_tie(pairs: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """n, wins of b, losses, ties, mean difference."""
    d = (F.col("b") - F.col("a")) * (1 if higher_is_better else -1)
    return pairs.agg(F.count("*").alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.avg(F.col("b") - F.col("a")).alias("mean_difference"))


def mcnemar(pairs: DataFrame, cut: float = 0.5) -> DataFrame:
    """Discordant counts at `cut` and the exact two-sided p."""
    x, y = F.col("a") >= cut, F.col("b") >= cut
    c = pairs.agg(F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # terms of the binomial tail by their logarithms, one from the last
    tail = F.aggregate(F.sequence(F.lit(0), k), F.struct(F.lit(0.0).alias("s"), (-n * F.log(F.lit(2.0))).alias("t")), lambda a, i: F.struct((a["s"] + F.exp(a["t"])).alias("s"), (a["t"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("t")), lambda a: a["s"])
    return c.select("only_a", "only_b", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p_value"))


def bootstrap_interval(pairs: DataFrame, key: str, resamples: int = 10_000, seed: int = 13, alpha: float = 0.05) -> DataFrame:
    """mean_difference, low, high: percentile interval of the mean paired difference (A10).

    Each draw is the row whose number is the hash of seed, resample and draw. Rows are numbered by key (whole
    numbers), in spans. Up to MOST_LOOKED_UP differences go to every task in eight bytes each, and tasks draw some
    resamples each; beyond that the draws are a range over all tasks, looked up by equality and averaged by resample.
    """
    n = pairs.count()
    d = ranked(pairs, [], key, "_at").select((F.col("_at") - 1).cast("long").alias("at"), (F.col("b") - F.col("a")).alias("d"))
    spark = pairs.sparkSession
    if 0 < n <= MOST_LOOKED_UP:
        return _interval(_looked_up(d, n, resamples, seed), d, resamples, alpha)
    hashed = F.conv(F.left(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("r"), F.col("i"))), F.lit(8)), 16, 10).cast("long")
    numbers = spark.range(resamples * n).select(F.floor(F.col("id") / max(1, n)).alias("r"), (F.col("id") % max(1, n)).alias("i")).select("r", F.pmod(hashed, F.lit(max(1, n))).alias("at"))
    return _interval(numbers.join(d, "at").groupBy("r").agg(F.round(F.avg("d"), 12).alias("m")), d, resamples, alpha)


def _looked_up(d: DataFrame, n: int, resamples: int, seed: int) -> DataFrame:
    """r, m: the mean of each resample, drawn where the differences are."""

    def gathered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        known = rows["known"].to_numpy(bool)
        return pd.DataFrame({"values": [rows["d"].to_numpy(float).tobytes()], "known": [b"" if known.all() else known.tobytes()]})

    def averaged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low, high, values, known in zip(b["low"], b["high"], b["values"], b["known"]):
                x = np.frombuffer(values)
                has = np.frombuffer(known, bool) if known else np.ones(len(x), bool)
                x = np.where(has, x, 0.0)
                total = {r: [0.0, 0] for r in range(low, high)}
                for r, drawn in draws(seed, list(total), n):
                    at = drawn % np.uint32(n)
                    total[r][0] += float(x[at].sum())
                    total[r][1] += int(has[at].sum()) if known else len(at)
                yield pd.DataFrame([(r, s / c if c else None) for r, (s, c) in total.items()], columns=["r", "m"])

    one = d.select("at", F.coalesce("d", F.lit(0.0)).alias("d"), F.col("d").isNotNull().alias("known")).groupBy().applyInPandas(gathered, "values binary, known binary")
    # some ten million draws a task, at most a thousand resamples
    tasks = max(-(-resamples // 1000), min(resamples, resamples * n // DRAWS))
    some = d.sparkSession.range(0, tasks, 1, tasks).select((F.col("id") * resamples / tasks).cast("long").alias("low"), ((F.col("id") + 1) * resamples / tasks).cast("long").alias("high"))
    return some.crossJoin(F.broadcast(one)).mapInPandas(averaged, "r long, m double").select("r", F.round("m", 12).alias("m"))


def _interval(means: DataFrame, d: DataFrame, resamples: int, alpha: float) -> DataFrame:
    m = means.withColumn("nth", F.row_number().over(W.orderBy("m", "r")))
    low, high = int(alpha / 2 * resamples), max(0, -(-int((1 - alpha / 2) * resamples * 1000) // 1000) - 1)
    return m.agg(F.max(F.when(F.col("nth") == low + 1, F.col("m"))).alias("low"), F.max(F.when(F.col("nth") == high + 1, F.col("m"))).alias("high")).crossJoin(d.agg(F.avg("d").alias("mean_difference"))).select("mean_difference", "low", "high")


def gate(summary: DataFrame, targets: list[tuple[str, str, float]]) -> DataFrame:
    """metric, value, target, passed, all_passed of a one-row summary against (metric, "min" or "max", target)."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(t).alias("target"), F.coalesce(F.col(m) >= t if kind == "min" else F.col(m) <= t, F.lit(False)).alias("passed")) for m, kind, t in targets))
    return summary.select(F.explode(rows).alias("g")).select("g.*").withColumn("all_passed", F.min("passed").over(W.partitionBy()))


def histogram(rows: DataFrame, reason: str, by: list[str]) -> DataFrame:
    """by, counts map<reason, n>."""
    n = rows.groupBy(*by, reason).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("counts"))


def first_mode(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The commonest value of each group, of equals the one seen first."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"))


def compared(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """key and a, b, delta of each metric over both runs' variants, a missing one as 0."""
    j = a.select(key, *(F.col(m).alias(f"{m}_a") for m in metrics)).join(b.select(key, *(F.col(m).alias(f"{m}_b") for m in metrics)), key, "full").fillna(0.0)
    return j.select(key, *(c for m in metrics for c in (F.col(f"{m}_a"), F.col(f"{m}_b"), (F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_delta"))))


def coverage(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """key, status of variants: missing, unexpected, or duplicate."""
    n = present.groupBy(key).agg(F.count("*").alias("n"))
    j = expected.select(key).distinct().withColumn("e", F.lit(True)).join(n, key, "full")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return j.select(key, status.alias("status")).where("status is not null")


def variant_id(strategy: Column | str, corpus: Column | str, reflection: Column, agentic: Column | None = None) -> Column:
    """strategy::corpus::refl_on|off[::agentic_on|off]."""
    on = lambda name, c: F.concat(F.lit(name), F.when(c, "_on").otherwise("_off"))
    return F.concat_ws("::", strategy, corpus, on("refl", reflection), *([] if agentic is None else [on("agentic", agentic)]))


def expected_variants(strategies: DataFrame, corpora: DataFrame) -> DataFrame:
    """Every strategy, corpus and reflection mode as a variant (R4); both tables are lists of names."""
    modes = F.explode(F.array(F.lit(True), F.lit(False)))
    return F.broadcast(strategies).crossJoin(F.broadcast(corpora)).select("strategy", "corpus", modes.alias("reflection")).withColumn("variant", variant_id("strategy", "corpus", F.col("reflection")))


def leaderboard(summaries: DataFrame, key: str) -> DataFrame:
    """Ranks by judge and document match, highest first, then latency, lowest first."""
    return summaries.withColumn("place", F.row_number().over(W.orderBy(F.desc("judge"), F.desc("doc_match"), "latency", key)))


def failures(results: DataFrame, key: str, k: int) -> DataFrame:
    """The k worst: judge lowest first, document match and latency highest first."""
    return results.orderBy("judge", F.desc("doc_match"), F.desc("latency"), key).limit(k)


def evidence_match(sources: DataFrame, doc: str, page: str, expected_doc: str, expected_page: str) -> DataFrame:
    """query_id, doc_match, page_match of retrieved sources (J15): keys that hold each other, 92% alike, or tokens shared.

    Similarity by characters is only computed for pairs that the two other tests leave open.
    """
    from seshat.functions.numbers import sequence_ratio

    a, b = T.normalize_doc_id(doc), T.normalize_doc_id(expected_doc)
    ta, tb = T.doc_id_tokens(doc), T.doc_id_tokens(expected_doc)
    easy = (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))
    shared = (F.size(tb) > 0) & (F.size(F.array_intersect(ta, tb)) >= F.greatest(F.lit(1), F.floor(F.size(tb) * 0.6)))
    s = sources.withColumn("_a", a).withColumn("_b", b).withColumn("_easy", easy | shared)
    s = s.withColumn("_r", F.when(F.col("_easy"), F.lit(1.0)).otherwise(sequence_ratio(F.when(~F.col("_easy"), F.col("_a")), F.when(~F.col("_easy"), F.col("_b")))))
    hit = F.col("_easy") | (F.col("_r") >= 0.92)
    return s.groupBy("query_id").agg(F.max(hit.cast("double")).alias("doc_match"), F.max((hit & F.coalesce(F.col(page) == F.col(expected_page), F.lit(False))).cast("double")).alias("page_match"))
