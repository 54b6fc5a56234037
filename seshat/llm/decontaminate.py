"""Benchmark decontamination: MinHash containment search for short test items inside long documents.

For a permutation of all shingles, the item's smallest shingle is a uniform draw from the item, so it lies in a
document with a probability equal to the item's containment there. Items are partitioned by size; each partition has
its own number of permutations and of agreements a candidate needs, set so that an item contained as asked is missed
with a probability below MISS. Candidates are verified on the exact shingles. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seshat.llm._io import settle, spare

MISS = 1e-9
#: (largest number of shingles of the partition, permutations)
PARTITIONS = ((8, 14), (32, 20), (128, 28), (1 << 40, 40))


def needed(permutations: int, share: float) -> int:
    """The most agreements to ask for without missing more than MISS at the given containment."""
    low, k = 0.0, 0
    while low + (p := comb(permutations, k) * share**k * (1 - share) ** (permutations - k)) <= MISS:
        low, k = low + p, k + 1
    return max(1, k)


def _words(text: F.Column) -> F.Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def exploded(df: DataFrame, size: int, keep: list[str], name: str, join: bool) -> DataFrame:
    """keep and each run of `size` words of column `text` in `name`: its hash, or the run itself with join.

    A text of fewer words gives no row.
    """
    w = df.where(F.col("text").isNotNull()).select(*keep, _words(F.col("text")).alias("w")).where(F.size("w") >= size)
    at = w.select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("i"))
    run = [F.get("w", F.col("i") + k) for k in range(size)]
    return at.select(*keep, (F.concat_ws(" ", *run) if join else F.xxhash64(*run)).alias(name))


def _runs(items: DataFrame, size: int) -> tuple[DataFrame, list[int]]:
    """item, run, h of each item, and the lengths of runs: `size` words, or all words of an item that has fewer."""
    n = F.size(_words(F.col("text")))
    found = items.where(F.col("text").isNotNull()).select("item", "text", F.least(n, F.lit(size)).alias("length")).where("length > 0")
    lengths = sorted(r["length"] for r in found.select("length").distinct().collect())  # at most `size` rows
    parts = [exploded(found.where(F.col("length") == k), k, ["item"], "run", True).distinct().withColumn("h", F.xxhash64(*[F.get(F.split("run", " "), F.lit(j)) for j in range(k)])) for k in lengths]
    return reduce(DataFrame.union, parts or [items.select("item", F.lit("").alias("run"), F.lit(0).cast("long").alias("h")).limit(0)]), lengths


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, percent: int = 80, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment: documents that hold an item, with what they hold of it.

    Both are lower-cased and cut at space and \\t-\\r; sets hold distinct runs of `size` words. An item of fewer words
    is one run of its own length, and is looked for among the runs of that length of every document. A row is given
    where 100 * shared >= percent * item_shingles. Null, empty and blank texts hold nothing and are held by nothing.
    Rows are told apart by their texts: repeated rows and null ids each give their rows. Items that share an id are
    united, items without one are left out. Other columns are left out, whatever their names. Empty tables give an empty result. Item tables of at
    most `broadcast_rows` runs are sent to every task; larger ones are joined by shuffle, where a run that many
    documents share is split by the skew handling of the join.
    """
    share = percent / 100
    text = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    runs, lengths = _runs(text, size)
    runs = settle(runs)
    counts = runs.groupBy("item").agg(F.count("*").alias("n"))
    chosen, agreements = F.lit(None).cast("int"), F.lit(None).cast("int")
    for most, permutations in reversed(PARTITIONS):
        chosen = F.when(F.col("n") <= most, permutations).otherwise(chosen)
        agreements = F.when(F.col("n") <= most, needed(permutations, share)).otherwise(agreements)
    drawn = runs.join(counts, "item").select("item", "h", F.explode(F.sequence(F.lit(1), chosen)).alias("j"))
    drawn = drawn.groupBy("item", "j").agg(F.min_by("h", F.xxhash64(F.lit(7), "j", "h")).alias("h"))
    sketch = settle(drawn.groupBy("item", "h").agg(F.count("*").alias("times")).join(counts, "item").select("item", "h", "times", agreements.alias("need")))
    small = runs.count() <= broadcast_rows and sketch.count() <= broadcast_rows
    sent = F.broadcast if small else (lambda df: df)

    def held(rows: DataFrame, name: str, join: bool) -> DataFrame:
        """The runs of the documents, of every length that an item has."""
        return reduce(DataFrame.union, [exploded(rows, k, ["key"], name, join) for k in lengths or [size]])

    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    met = held(rows, "h", False).join(sent(sketch), "h").select("key", "item", "h", "times", "need").distinct()
    candidates = met.groupBy("key", "item").agg(F.sum("times").alias("met"), F.first("need").alias("need")).where("met >= need").select("key", "item")
    candidates = settle(candidates)
    keys = candidates.select("key").distinct()
    keys = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    shared = held(rows.join(keys, "key", "left_semi"), "run", True).distinct()
    shared = shared.join(sent(runs.select("item", "run")), "run").groupBy("key", "item").agg(F.count("*").alias("shared"))
    found = shared.join(candidates, ["key", "item"]).join(sent(counts), "item").where(F.col("shared") * 100 >= F.col("n") * percent)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key")).join(found, "key")
    return named.select("doc_id", F.col("item").alias("item_id"), "shared", F.col("n").alias("item_shingles"), (F.col("shared") / F.col("n")).alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no item, with their columns; options are those of contaminated.

    Rows are kept or dropped by their texts alone: null, empty and blank ones stay, repeated rows and null ids share
    the fate of their text, and columns of any name stay as they are.
    """
    text = options.get("text_col", "text")
    key = spare("seshat_key", docs.columns)
    found = contaminated(docs.select(F.xxhash64(text).alias("seshat_id"), text), items, id_col="seshat_id", **options).select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64(text)).join(settle(found), key, "left_anti").select(*docs.columns)
