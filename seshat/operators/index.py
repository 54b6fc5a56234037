"""A stored full-text index: postings by buckets of terms, kept up by upserts and deletes, searched without the texts.

Each change is a commit with its postings, its rows' lengths, and the ids whose earlier rows are void from then on.
A search reads the buckets of the asked terms and the lengths; compaction merges all commits into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seshat.operators import fulltext
from seshat.operators.vectors import sent
from seshat.sources.commits import Commits

BUCKETS = 64


class TextIndex:
    """Rows by id (long) under a folder. A null id or text is not indexed; of rows that share an id in one change any one stays."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, analysed: Callable[[Column | str], Column] = fulltext.terms):
        self.spark, self.buckets, self.store, self.analysed = spark, buckets, Commits(spark, path), analysed

    def upsert(self, rows: DataFrame, row_id: str = "id", content: str = "content") -> None:
        """Index rows, in place of what their ids had before."""
        r = rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(content).alias("content"))
        r = r.groupBy("id").agg(F.first("content", ignorenulls=True).alias("content"))
        t = r.where(F.col("content").isNotNull()).select("id", self.analysed("content").alias("t"))
        lengths = t.select("id", F.size("t").alias("length"))
        counted = t.select("id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
        self._commit(counted, lengths, r.select("id"))

    def delete(self, ids: DataFrame, row_id: str = "id") -> None:
        gone = ids.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id")).distinct()
        none = self.spark.createDataFrame([], "id long, length int, term string, tf long")
        self._commit(none, none.select("id", "length"), gone)

    def _commit(self, postings: DataFrame, lengths: DataFrame, gone: DataFrame) -> str:
        # a bucket's terms lie together, in order: a search reads few row groups of it
        p = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        p = p.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term", "id")
        return self.store.write({"postings": p, "lengths": lengths, "gone": gone}, {"postings": "bucket"})

    def _live(self, table: str, names: list[str]) -> DataFrame:
        """A table without the rows that a later commit has made void."""
        rows = self.store.read(table, names)
        if len(names) < 2:
            return rows
        later = self.store.read("gone", names[1:]).groupBy("id").agg(F.max("commit").alias("_last"))
        return rows.join(sent(later), "id", "left").where(F.col("_last").isNull() | (F.col("commit") >= F.col("_last"))).drop("_last")

    def postings(self, queries: DataFrame, query_id: str = "query_id", query_text: str = "query") -> fulltext.Postings:
        """What fulltext.postings gives, from what is stored: searches take either."""
        names = self.store.names()
        q = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(self.analysed(query_text))).alias("term"))
        asked = q.select("term").distinct()
        small = q.limit(fulltext.MOST_SENT + 1).count() <= fulltext.MOST_SENT
        if not names:
            return fulltext.Postings(q, self.spark.createDataFrame([], "id long, length int, term string, tf long"), small)
        # the buckets are a fixed number: those of the asked terms prune the folders that are read
        wanted = [r["b"] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]
        p = self._live("postings", names).where(F.col("bucket").isin(wanted) if wanted else F.lit(False))
        p = p.join(F.broadcast(asked) if small else asked, "term").select("id", "length", "term", "tf")
        every = self._live("lengths", names).select("id", "length", F.lit("").alias("term"), F.lit(1).cast("long").alias("tf"))
        return fulltext.Postings(q, p.unionByName(every), small)

    def frequencies(self) -> DataFrame:
        """term, df: in how many rows each term stands."""
        return self._live("postings", self.store.names()).groupBy("term").agg(F.count("*").alias("df"))

    def compact(self) -> None:
        """Merge all commits into one; a reader of the old ones must be done with them."""
        names = self.store.names()
        if len(names) > 1:
            lengths = self._live("lengths", names).select("id", "length")
            self._commit(self._live("postings", names).select("id", "length", "term", "tf"), lengths, self.store.read("gone", names).select("id").distinct())
            self.store.forget(names)
