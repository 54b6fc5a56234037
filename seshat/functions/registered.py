"""The functions of this package that SQL has no expression for, under names of their own in a session."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, Row, StringType, StructField, StructType

from seshat.functions.numbers import safe_eval, sequence_ratio


@udtf(returnType=StructType([StructField("nth", IntegerType()), StructField("part", StringType())]))
class Parts:
    """nth, part: a text cut at a separator, from 0; no rows for a null text."""

    def eval(self, text: str | None, separator: str) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(text.split(separator) if separator else [text])


MARK = re.compile(r"-+\s*Page\s*(\d+)\s*-+", re.IGNORECASE)


@udtf(returnType=StructType([StructField("page", IntegerType()), StructField("content", StringType())]))
class Pages:
    """page, content: a text cut at its page marks, as chunking.pages cuts it; empty pages are left out, no rows for a null text."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        if text is None:
            return
        parts = MARK.split(text)
        found = list(zip(map(int, parts[1::2]), parts[2::2])) or [(1, re.sub(r"^(?:Document|Title): [^\n]*\n?", "", text))]
        yield from ((page, content.strip()) for page, content in found if content.strip())


@udtf(returnType=StructType([StructField("part", StringType()), StructField("node", LongType()), StructField("hop", IntegerType()), StructField("score", DoubleType())]))
class GraphSearch:
    """part, node, hop, score: what seeds reach along edges within `depth` steps, the `top_k` of the best scores of a partition.

    Takes a table of part, src, dst, score, partitioned by part and ordered by src and dst, nulls first, whose edges lead
    to larger ids: rows without src are seeds (dst) with their scores, and an edge hands on the score of its src times
    its own. A node has the best score that reaches it, of equals the one of the fewest steps. Every edge into a node
    comes before those out of it, so one pass is enough, and a node that the order has passed is held no longer.
    """

    def __init__(self):
        self.part, self.open, self.best = None, {}, []

    def eval(self, row: Row, depth: int, top_k: int) -> None:
        self.part, self.top_k = row["part"], top_k
        src, dst, score = row["src"], row["dst"], row["score"]
        if src is None:
            self._reach(dst, -score, 0)
            return
        self._pass(src)
        for hop, reached in self.open.get(src, {}).items():
            if hop < depth:
                self._reach(dst, reached * score, hop + 1)

    def terminate(self) -> Iterator[tuple[str, int, int, float]]:
        self._pass(None)
        yield from ((self.part, node, hop, -score) for score, hop, node in self.best)

    def _reach(self, node: int, score: float, hop: int) -> None:
        # the best score of each number of steps, as a lower one of fewer steps may lead further; held below zero,
        # so that the smaller of two is the better
        scores = self.open.setdefault(node, {})
        scores[hop] = min(scores.get(hop, score), score)

    def _pass(self, src: int | None) -> None:
        gone = [n for n in self.open if src is None or n < src]
        if gone:
            found = [(*min((score, hop) for hop, score in self.open.pop(n).items()), n) for n in gone]
            self.best = sorted([*self.best, *found])[: self.top_k]


def register(spark: SparkSession) -> None:
    """seshat_eval, seshat_ratio and the table functions seshat_parts, seshat_pages and seshat_graph_search for spark.sql."""
    spark.udf.register("seshat_eval", safe_eval)
    spark.udf.register("seshat_ratio", sequence_ratio)
    spark.udtf.register("seshat_parts", Parts)
    spark.udtf.register("seshat_pages", Pages)
    spark.udtf.register("seshat_graph_search", GraphSearch)
