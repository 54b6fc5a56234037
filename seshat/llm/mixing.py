"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt over blocks by hash, and a source's quota is a number of block draws: whole passes
over its blocks and, for the rest, the first blocks of a permutation of its own; the last block drawn is cut, inside
it one document. A tree deals the draws over the output shards: the root holds the exact number of draws of every
source, each node deals its draws to its two halves by a multivariate-hypergeometric draw, and the leaves are the
shards. A shard takes as many draws of each source as its leaf says, as a run of the source's permuted draws that no
other shard has, and shuffles them.

Running sums and numbers within a source are taken in two steps, over buckets of the permutation and then within each
bucket, so that no task holds all blocks of a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seshat.llm._io import groups, settle

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
SPACE = r"[^\x20\x09-\x0D]+"
#: Draws that the generator of hypergeometric numbers takes; shards dealt by one task of the tree; rows of a bucket.
MOST_DRAWS, SUBTREE, BUCKET = 1_000_000_000, 1024, 4096
#: Sources sent to every task, at most; more are joined by shuffle.
MOST_SENT = 500_000


def sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `size`, the number of words (null: 0), and `text_key`, a hash of the text, in place of the text."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE)), F.lit(0)).cast("long")
    others = [c for c in docs.columns if c not in (text_col, "size", "text_key")]
    return docs.select(*others, size.alias("size"), F.xxhash64(text_col).alias("text_key"))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above MOST_PASSES times its source.

    The excess of sources at their limit is shared by weight among the others until none is above: with limits sorted
    by limit over weight, the sources below the level reached are at their limit, the rest at level times weight. The
    window runs over one row a source.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1)
    s = sources.withColumn("w", weight).withColumn("limit", F.lit(float(MOST_PASSES)) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("limit") / F.col("w"))
    every = W.partitionBy()
    rising = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("level", F.try_divide(F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)), F.sum("w").over(after)))
    # the level is that of the first source that does not reach its limit
    s = s.withColumn("nth", F.row_number().over(rising))
    s = s.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.least("limit", F.coalesce(F.col("final") * F.col("w"), F.col("limit"))).alias("target"))


def _dealt(counts: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """`want` draws from sources that hold `counts`: a multivariate-hypergeometric draw."""
    return rng.multivariate_hypergeometric(counts, want, method="marginals") if want else np.zeros_like(counts)


def split_counts(at: np.ndarray, counts: np.ndarray, low: int, high: int, seed: int, step: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first shard, sources, draws) of every `step` shards of low..high, halving the draws of a node at a time.

    at, counts: the sources of the node and their draws. Shards differ by one draw at most. Only sources with draws
    left are carried down, so that the whole walk holds a few rows a source.
    """
    stack = [(low, high, at, counts)]
    while stack:
        a, b, at, c = stack.pop()
        if b - a <= step:
            yield a, at, c
            continue
        units = -(-(b - a) // step)
        mid = a + units // 2 * step
        per, over = divmod(int(c.sum()), b - a)
        left = _dealt(c, per * (mid - a) + min(over, mid - a), np.random.default_rng([seed, a, b]))
        for x, y, part in ((mid, b, c - left), (a, mid, left)):
            stack.append((x, y, at[part > 0], part[part > 0]))


def leaves(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, shard, n): how many draws of each source each shard takes, from quotas (source_no, n).

    The upper tree, down to subtrees of SUBTREE shards, is one task over one row a source; each subtree is a task.
    """

    def upper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"source_no": [], "n": []}), *batches]).sort_values("source_no")
        for shard, at, n in split_counts(rows.source_no.to_numpy(np.int64), rows.n.to_numpy(np.int64), 0, shards, seed, SUBTREE):
            yield pd.DataFrame({"shard": shard, "source_no": at, "n": n})

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "shard"):
            low = int(g.shard.iloc[0])
            for shard, at, n in split_counts(g.source_no.to_numpy(np.int64), g.n.to_numpy(np.int64), low, min(shards, low + SUBTREE), seed):
                yield pd.DataFrame({"shard": shard, "source_no": at, "n": n})

    schema = "shard long, source_no long, n long"
    top = settle(quotas.coalesce(1).mapInPandas(upper, schema))
    return top.repartition("shard").sortWithinPartitions("shard", "source_no").mapInPandas(lower, schema)


def _running(rows: DataFrame, by: str, bucket: str, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows before in `by`, which come by bucket and then by order."""
    sums = rows.groupBy(by, bucket).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(by, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy(by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(sums, [by, bucket]).withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_base", "_in")


def _bucket(hashed: Column, buckets: Column) -> Column:
    """The part of the range of a 64-bit hash, of `buckets` parts in order."""
    return F.floor(((hashed.cast("double") + 2.0**63) / 2.0**64) * buckets).cast("long")


def draws(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, block, pass, words, shard, place): every block draw, the words it takes, its shard and order there.

    blocks: source_no, block, block_size, source_size, target, source_blocks.
    """
    target = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("int")
    b = blocks.withColumn("whole", whole).withColumn("quota", target - whole * F.col("source_size"))
    b = b.withColumn("order", F.xxhash64(F.lit(seed), F.lit("rest"), "block")).withColumn("bucket", _bucket(F.col("order"), F.ceil(F.col("source_blocks") / BUCKET)))
    b = _running(b, "source_no", "bucket", ["order", "block"], F.col("block_size"), "before")
    b = b.withColumn("rest", F.greatest(F.lit(0), F.least("block_size", F.col("quota") - F.col("before"))))
    passes = F.transform(F.sequence(F.lit(0), F.col("whole")), lambda p: F.struct(p.alias("pass"), F.when(p < F.col("whole"), F.col("block_size")).otherwise(F.col("rest")).alias("words")))
    d = b.select("source_no", "source_blocks", "block", F.explode(F.filter(passes, lambda x: x["words"] > 0)).alias("x"))
    d = d.select("source_no", "source_blocks", "block", "x.pass", "x.words").withColumn("order", F.xxhash64(F.lit(seed), "pass", "block"))
    d = settle(d.withColumn("bucket", _bucket(F.col("order"), F.ceil(F.col("source_blocks") / BUCKET))).drop("source_blocks"))
    numbered = _running(d, "source_no", "bucket", ["order", "pass", "block"], F.lit(1), "nth")
    quotas = d.groupBy("source_no").agg(F.count("*").alias("n"))
    leaf = settle(leaves(quotas, shards, seed))
    # a source's draws go to the shards in order: one run a shard
    runs = leaf.withColumn("part", F.floor(F.col("shard") / BUCKET).cast("long"))
    runs = _running(runs, "source_no", "part", ["shard"], F.col("n"), "first")
    # draws and runs meet in spans of BUCKET numbers; a run is in each span that it reaches
    span = F.explode(F.sequence(F.floor(F.col("first") / BUCKET), F.floor((F.col("first") + F.col("n") - 1) / BUCKET)))
    runs = runs.select("source_no", "shard", "first", F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("pass"), F.lit(None).cast("long").alias("words"), span.alias("span"), F.lit(0).alias("kind"))
    rows = numbered.select("source_no", F.lit(None).cast("long").alias("shard"), F.col("nth").alias("first"), "block", "pass", "words", F.floor(F.col("nth") / BUCKET).alias("span"), F.lit(1).alias("kind"))
    last = F.last("shard", True).over(W.partitionBy("source_no", "span").orderBy("first", "kind").rowsBetween(W.unboundedPreceding, 0))
    found = runs.unionByName(rows).withColumn("shard", last).where("kind = 1")
    place = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), F.lit("place"), "source_no", "block", "pass"), "source_no", "block", "pass"))
    return found.select("source_no", "block", "pass", "words", "shard", place.alias("place"))


def mixture(docs: DataFrame, block_words: int = 20_000, shard_blocks: int = 64, least_blocks: int = 32, seed: int = 1) -> DataFrame:
    """Every row of docs with size, source_size, target, taken and draws array<struct<pass, shard, place, words>>.

    docs: doc_id, source, size (words; null counts as 0), text_key if there is one (see sizes) and any other columns,
    which are kept unless one bears a name of the result. Sources by code point, null last, weigh 5, 2, 1, repeating;
    their targets share 100% of all words, none above three times its source. draws: in which passes over its source
    and in which shards the row is taken, the place of its block there and the words taken; taken is their sum. It is
    a multiple of the size but for one document a source, cut where the quota ends. Blocks hold about `block_words`
    words at every size of input, less where a source has too few for `least_blocks`; a shard holds about
    `shard_blocks` block draws. More than MOST_DRAWS draws raise an error: ask for larger blocks. The same rows give
    the same mix. Null and repeated ids are rows like any other, dealt by their texts; rows equal in id, size and text
    lie in one block. Rows without words and empty tables take nothing.
    """
    own = ["size", "source_size", "target", "taken", "draws"]
    others = [c for c in docs.columns if c not in ["doc_id", "source", "text_key", *own]]
    key = F.col("text_key") if "text_key" in docs.columns else F.lit(0).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), key.alias("_key"), F.struct(*others, F.lit(0).alias("_none")).alias("_others"))
    rows = settle(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = targets(sources).withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    known = settle(known.select(F.col("source").alias("_source"), "source_no", "source_size", "target"))
    dealt = F.greatest(F.lit(1), F.least(F.ceil(F.col("source_size") / block_words) + least_blocks - 1, F.col("source_size"))).cast("long")
    sent = F.broadcast(known) if known.count() <= MOST_SENT else known
    placed = rows.join(sent, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = settle(placed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "_key"), dealt)))
    blocks = placed.groupBy("source_no", "block").agg(F.sum("size").alias("block_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first(dealt).alias("source_blocks")).where("block_size > 0")
    blocks = settle(blocks)
    n, passes = blocks.agg(F.count("*"), F.sum(F.ceil(F.col("target") / F.col("source_size")))).first()
    if (passes or 0) > MOST_DRAWS:
        raise ValueError(f"{passes} block draws: raise block_words")
    drawn = draws(blocks, max(1, -(-n // shard_blocks)), seed)
    per_block = drawn.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "place", "words"))).alias("drawn"))
    # where in its block a document starts
    order = W.partitionBy("source_no", "block").orderBy(F.xxhash64(F.lit(seed), F.lit("low"), "doc_id", "_key"), "doc_id", "size", "_key")
    low = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = placed.withColumn("low", low).join(per_block, ["source_no", "block"], "left")
    took = F.transform("drawn", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), d["place"].alias("place"), F.greatest(F.lit(0), F.least(F.col("size"), d["words"] - F.col("low"))).alias("words")))
    took = F.filter(F.coalesce(took, F.array().cast("array<struct<pass:int,shard:bigint,place:int,words:bigint>>")), lambda d: d["words"] > 0)
    out = out.withColumn("draws", took).withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
    return out.select("doc_id", "source", *own, *(F.col("_others").getField(c).alias(c) for c in others))


def drawn_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: one row for each draw of a document, with its pass, shard, the block's place in it and words.

    Columns of mixed that bear one of those names are left out.
    """
    named = ["pass", "shard", "place", "words"]
    return mixed.select(*(c for c in mixed.columns if c not in ["draws", *named]), F.explode("draws").alias("_draw")).select("*", *(F.col(f"_draw.{c}").alias(c) for c in named)).drop("_draw")
