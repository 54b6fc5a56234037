"""Turns of an answering run folded into its state, and the gate and rescue of evidence entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seshat.functions import text as T
from seshat.operators.evidence import missing_slots

# Turns of a run, its tool calls, and context citations that a rescue asks for.
MOST_TURNS, MOST_CALLS, LEAST_CITATIONS = 6, 3, 4


def ran(turns: DataFrame, runs: DataFrame, most_turns: int = MOST_TURNS, most_calls: int = MOST_CALLS) -> DataFrame:
    """The state of each run after its turns (E21, E45): turns folded in order until the run stops.

    runs: query_id, n_required, bootstrap array<string> (ids that the search before the first turn found; null for no
    such search). turns: query_id, turn, tool (whether it called a tool), answered (whether it gave an answer that was
    accepted), found array<string> (ids), new_entries, ledger (entries after it), missing (slots after it). A run stops
    before a turn when its slots are covered after more than one call, or its calls are spent, and with an answer. Columns:
    query_id, n_turns, n_calls, n_seen (distinct ids), no_progress (turns in a row that brought nothing), stopped
    (covered, calls spent, answered, turns spent, no more turns), forced (whether an answer must still be made). No more
    than most_turns turns of a run leave the tasks that read them.
    """
    t = turns.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy("turn"))).where(F.col("_r") <= most_turns)
    one = F.struct("_r", "tool", "answered", F.coalesce("found", F.array().cast("array<string>")).alias("found"), "new_entries", "ledger", "missing")
    g = t.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    r = runs.select("query_id", "n_required", "bootstrap").join(g, "query_id", "left")
    none = F.array().cast("array<string>")
    fields = {"calls": F.when(F.col("bootstrap").isNotNull(), 1).otherwise(0), "seen": F.array_distinct(F.coalesce("bootstrap", none)), "idle": F.lit(0), "n": F.lit(0), "ledger": F.lit(0).cast("long"), "missing": F.col("n_required").cast("long"), "why": F.lit(None).cast("string")}
    start = F.struct(*(v.alias(k) for k, v in fields.items()))

    def stops(a: Column) -> Column:
        covered = F.when(F.col("n_required") > 0, (a["missing"] == 0) & (a["ledger"] >= F.col("n_required"))).otherwise(a["ledger"] > 0)
        return F.when(covered & (a["calls"] > 1), "covered").when(a["calls"] >= most_calls, "calls spent")

    def step(a: Column, x: Column) -> Column:
        why = F.coalesce(a["why"], stops(a))
        used = F.coalesce(x["tool"], F.lit(False))
        idle = F.when((F.coalesce(x["new_entries"], F.lit(0)) == 0) & (F.coalesce(x["missing"], F.lit(0)) > 0), a["idle"] + 1).otherwise(0)
        went = {
            "calls": a["calls"] + F.when(used, 1).otherwise(0), "seen": F.when(used, F.array_union(a["seen"], x["found"])).otherwise(a["seen"]), "idle": F.when(used, idle).otherwise(a["idle"]), "n": a["n"] + 1,
            "ledger": F.when(used, F.coalesce(x["ledger"], a["ledger"]).cast("long")).otherwise(a["ledger"]), "missing": F.when(used, F.coalesce(x["missing"], a["missing"]).cast("long")).otherwise(a["missing"]),
            "why": F.when(~used & F.coalesce(x["answered"], F.lit(False)), "answered"),
        }
        stayed = {k: a[k] for k in fields} | {"why": why}
        return F.struct(*(F.when(why.isNotNull(), stayed[k]).otherwise(went[k]).alias(k) for k in fields))

    out = r.withColumn("z", F.aggregate(F.coalesce("turns", F.array().cast(g.schema["turns"].dataType)), start, step))
    ended = F.when(F.col("z.n") >= most_turns, "turns spent").otherwise("no more turns")
    stopped = F.coalesce("z.why", F.when(F.col("z.n") < most_turns, stops(F.col("z"))), ended)
    return out.select("query_id", F.col("z.n").alias("n_turns"), F.col("z.calls").alias("n_calls"), F.size("z.seen").alias("n_seen"), F.col("z.idle").alias("no_progress"), stopped.alias("stopped"), (stopped != "answered").alias("forced"))


def gated(entries: DataFrame, decisions: DataFrame, required: DataFrame, states: DataFrame) -> DataFrame:
    """entries that a gate keeps, with kept_by: gate, fallback or bypass.

    entries: query_id, nth, slot_key, value; decisions: query_id, nth, keep (entries without one are kept); required:
    query_id, slot_key; states: query_id, answer_type. Entries of computations are not gated. When the gate leaves a
    required slot without a value that the entries gave one, the slot's first entry comes back; when it leaves nothing
    at all, the query's first does. Whole queries are compared, before and after, by what their slots hold.
    """
    d = decisions.groupBy("query_id", "nth").agg(F.bool_and(F.coalesce("keep", F.lit(False))).alias("keep"))
    e = entries.join(d, ["query_id", "nth"], "left").join(states.select("query_id", (F.col("answer_type") == "compute").alias("_free")), "query_id", "left")
    e = e.withColumn("_free", F.coalesce("_free", F.lit(False))).withColumn("_kept", F.col("_free") | F.coalesce("keep", F.lit(True)))
    lost = missing_slots(required, e.where("_kept")).join(missing_slots(required, e), ["query_id", "slot_key"], "left_anti").withColumn("_lost", F.lit(True))
    e = e.join(lost, ["query_id", "slot_key"], "left")
    slot = W.partitionBy("query_id", "slot_key")
    bare = F.length(T.text("slot_key")) == 0
    first = F.row_number().over(slot.orderBy("nth")) == 1
    back = F.coalesce("_lost", F.lit(False)) & ~bare & first & ~F.max("_kept").over(slot)
    e = e.withColumn("_back", back)
    left = e.groupBy("query_id").agg(F.bool_or(F.col("_kept") | F.col("_back")).alias("_any"), F.min("nth").alias("_first"))
    e = e.join(left, "query_id")
    by = F.when(F.col("_free"), "bypass").when(F.col("_kept"), "gate").when(F.col("_back") | (~F.col("_any") & (F.col("nth") == F.col("_first"))), "fallback")
    return e.select(*entries.columns, by.alias("kept_by")).where(F.col("kept_by").isNotNull())


def rescues(states: DataFrame) -> DataFrame:
    """states with zero_entries, citation_repair and slot_rescue: which rescue an extraction calls for.

    states: answer_type, entries_raw, accepted, n_required, n_missing, citations (in the context), context, reasons
    map<string, int> of rejections.
    """
    n = lambda reason: F.coalesce(F.try_element_at("reasons", F.lit(reason)), F.lit(0))
    some = F.length(F.trim(T.text("context"))) > 0
    counted = F.map_filter(F.coalesce("reasons", F.expr("map()").cast("map<string,int>")), lambda k, v: ~F.startswith(k, F.lit("entry_gate:")))
    total = F.aggregate(F.map_values(counted), F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)))
    period, enough = n("value_period_mismatch") > 0, F.col("citations") >= LEAST_CITATIONS
    other = (F.coalesce("accepted", F.lit(0)) == 0) & F.when(enough, period | (total >= 2) | (F.col("n_required") >= 2)).otherwise(period & (F.col("citations") >= 1))
    slot = (F.col("n_missing") > 0) & F.when(F.col("answer_type") == "compute", F.col("citations") >= 1).otherwise(other)
    repair = (F.col("n_missing") > 0) & some & ((n("invalid_citation_format") > 0) | (n("citation_not_in_context") > 0))
    return states.withColumn("zero_entries", (F.col("entries_raw") == 0) & (F.col("n_required") > 0) & some).withColumn("citation_repair", repair).withColumn("slot_rescue", slot)
