"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a lexicon learned from labelled texts (words and word beginnings that mark toxic
ones), how near its hits stand to words of the second person, capitals, punctuation, and spellings that hide words.
The lexicon is cross-fitted: each half of the training rows is measured by the lexicon of the other half, so that the
trees see hits as they will meet them; the lexicon of all training rows serves afterwards. A text is always read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
# Characters that stand for letters in hidden spellings.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
WORD = re.compile(r"[^\s]+")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"
NEAR = 5
FEATURES = ("hits_per_word", "weight_per_word", "log_hits", "best_weight", "log_weight", "near_you", "you_per_word", "capitals", "punctuation", "hidden", "log_words")


def _word(raw: str) -> tuple[str, bool]:
    """A token as the lexicon knows it; whether letters were hidden behind other characters."""
    w = raw.strip(EDGE)
    if w.isalpha() or not w:
        return w, False
    if any(c.isalpha() for c in w):
        plain = "".join(c for c in w.translate(STANDS_FOR) if c.isalpha())
        return plain, plain != w
    return "", False


def _stems(word: str) -> list[str]:
    """A word and its beginnings of four to six letters, as lexicon entries."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) >= k)] if len(word) > 2 else []


class Measure:
    """Features of texts under a lexicon of entry: weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple[float, bool, bool]] = {}

    def _look(self, raw: str) -> tuple[float, bool, bool]:
        w, hidden = _word(raw)
        weight = max((self.lexicon.get(s, 0.0) for s in _stems(w)), default=0.0)
        return weight, w in SECOND_PERSON, hidden

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = text.lower().split()
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for t in set(tokens):
            if t not in known:
                known[t] = self._look(t)
        seen = [known[t] for t in tokens]
        n = max(1, len(tokens))
        hit = [i for i, s in enumerate(seen) if s[0]]
        you = [i for i, s in enumerate(seen) if s[1]]
        near = 0
        if hit and you:
            at = np.searchsorted(you, hit)
            y = np.array([-1 << 40, *you, 1 << 40])
            near = int((np.minimum(np.abs(y[at] - hit), np.abs(y[at + 1] - hit)) <= NEAR).sum())
        weights = [seen[i][0] for i in hit]
        data = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        capitals, small = data[65:91].sum(), data[97:123].sum()
        marks = data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum()
        total = sum(weights)
        return [len(hit) / n, total / n, np.log1p(len(hit)), max(weights, default=0.0), np.log1p(total), near / n, len(you) / n, capitals / max(1, capitals + small), marks / max(1, data.sum()), sum(s[2] for s in seen) / n, np.log1p(len(tokens))]


class Trees:
    """Gradient-boosted trees on the logistic loss over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.cuts: list[np.ndarray] = []
        self.trees: list[dict] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree = self._grow(binned, g, h, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self._out(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, col, "left") for c, col in zip(self.cuts, x.T)], 1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> dict:
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        for k in range(b.shape[1] if depth else 0):
            n = len(self.cuts[k]) + 1
            gl = np.cumsum(np.bincount(b[rows, k], g[rows], n))[:-1]
            hl = np.cumsum(np.bincount(b[rows, k], h[rows], n))[:-1]
            gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
            gain[(hl < self.least * 0.05) | (H - hl < self.least * 0.05)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), k, int(gain.argmax()))
        if best[1] < 0:
            return {"leaf": self.rate * float(G / (H + 1))}
        left = b[rows, best[1]] <= best[2]
        return {"at": best[1], "cut": best[2], "low": self._grow(b, g, h, rows[left], depth - 1), "high": self._grow(b, g, h, rows[~left], depth - 1)}

    def _out(self, tree: dict, b: np.ndarray) -> np.ndarray:
        if "leaf" in tree:
            return np.full(len(b), tree["leaf"])
        low = b[:, tree["at"]] <= tree["cut"]
        return np.where(low, self._out(tree["low"], b), self._out(tree["high"], b))

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.base + sum((self._out(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the rising probabilities at them, with one row added to each side."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order], y[order].astype(float)):
        blocks.append([m, m, v, 1.0])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            low, high, s, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + s, blocks[-1][3] + n]
    x = np.array([e for b in blocks for e in ((b[0], b[1]) if b[0] < b[1] else (b[0],))])
    p = np.array([(b[2] + 0.5 * (b[2] / b[3])) / (b[3] + 0.5) for b in blocks for _ in range(2 if b[0] < b[1] else 1)])
    return x, p


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, steps: tuple[np.ndarray, np.ndarray] | None, prior: float):
        self.lexicon, self.trees, self.steps, self.prior = lexicon, trees, steps, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.prior)
        m = self.trees.margin(x)
        p = np.interp(m, *self.steps) if self.steps is not None else 1 / (1 + np.exp(-m))
        return np.clip(0.999 * p + 0.001 / (1 + np.exp(-m)), 0, 1)  # the margin parts what the steps tie


def _part(column: str) -> F.Column:
    return F.pmod(F.xxhash64(F.lit("part"), column), F.lit(10))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, sample_rows: int) -> DataFrame:
    """id, text, label, part of at most `sample_rows` labelled rows outside the held-out fold, the first by hash of the id.

    A repeated id is one row, with the first of its texts in order. The same rows are picked on every cluster.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).withColumn("hash", F.xxhash64("id"))
    total = known.count()
    if total > sample_rows:  # a few more than asked for, of which the first are taken
        most = min(1.0, (sample_rows + 10 * sample_rows**0.5) / total)
        known = known.where(F.col("hash") <= F.lit(int(-(2**63) + most * (2**64 - 1)))).orderBy("hash", "id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.join(F.broadcast(known.drop("hash")), "id")
    return met.groupBy("id", "label").agg(F.min("text").alias("text")).withColumn("part", _part("id"))


def learned_lexicon(rows: DataFrame, entries: int) -> tuple[list[dict[str, float]], dict[str, float]]:
    """Lexicons of the even parts, of the odd parts and of all: entries whose document frequency marks label 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: dict[tuple[int, int], Counter] = {(h, y): Counter() for h in (0, 1) for y in (0, 1)}
        for x in batches:
            for text, y, part in zip(x.text, x.label, x.part):
                seen: set[str] = set()
                for t in set((text or "").lower().split()):
                    seen.update(_stems(_word(t)[0]))
                count[int(part) % 2, int(y > 0)].update(seen)
        every = sorted(set().union(*count.values()))
        if every:
            yield pd.DataFrame({"entry": every, **{f"n{h}{y}": [c[e] for e in every] for (h, y), c in count.items()}})

    names = ["n00", "n01", "n10", "n11"]
    df = rows.select("text", "label", "part").mapInPandas(run, "entry string, n00 long, n01 long, n10 long, n11 long").groupBy("entry").agg(*(F.sum(c).alias(c) for c in names))
    size = {(int(r["h"]), int(r["y"])): r["n"] for r in rows.groupBy((F.col("part") % 2).alias("h"), (F.col("label") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}

    def of(halves: tuple[int, ...]) -> dict[str, float]:
        bad = sum(size.get((h, 1), 0) for h in halves)
        good = sum(size.get((h, 0), 0) for h in halves)
        a = sum((F.col(f"n{h}1") for h in halves), F.lit(0))
        b = sum((F.col(f"n{h}0") for h in halves), F.lit(0))
        weight = F.log(((a + 0.5) / (bad + 1)) / ((b + 0.5) / (good + 1)))
        # likelihood ratio of the entry's toxic share against the share overall
        share = bad / max(1, bad + good)
        g = 2 * (a * F.log(F.greatest(a, F.lit(1e-9)) / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0))
        top = df.where((a >= 3) & (weight > 1)).select("entry", (weight * F.least(F.lit(1.0), a / 20)).alias("weight"), g.alias("g"))
        top = top.where("g > 11").orderBy(F.desc("g"), "entry").limit(entries)
        return {r["entry"]: float(r["weight"]) for r in top.collect()} if bad and good else {}

    df = df.where("n01 + n11 >= 3").persist()
    out = [of((0,)), of((1,))], of((0, 1))
    df.unpersist()
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = 12_000, entries: int = 4000) -> Model:
    """Learn from at most `sample_rows` labelled rows outside the held-out fold; the bound does not grow with the input.

    Null labels are left out; a document labelled twice counts as toxic if either says so. Without both labels in the
    sample the model is the share of toxic rows (0 without rows).
    """
    rows = training_rows(docs, labels, label_col, sample_rows).persist()
    halves, lexicon = learned_lexicon(rows, entries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measures = [Measure(halves[1]), Measure(halves[0])]
        for x in batches:
            yield pd.DataFrame({"part": x.part, "label": x.label, "x": [measures[int(p) % 2](t) for t, p in zip(x.text, x.part)]})

    got = rows.select("text", "label", "part", "id").mapInPandas(run, "part long, label int, x array<double>").toPandas()
    rows.unpersist()
    y = (got.label.to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, None, float(y.mean()) if len(y) else 0.0)
    x = np.array(got.x.tolist())
    order = np.lexsort((*x.T, y, got.part.to_numpy()))  # the same whatever order the rows arrive in
    x, y, part = x[order], y[order], got.part.to_numpy()[order]
    # margins for the calibration come from trees that have not seen the row
    margin = np.zeros(len(y))
    for k in range(2):
        own = part // 2 % 2 == k
        if 0 < y[~own].sum() < (~own).sum():
            margin[own] = Trees().fit(x[~own], y[~own]).margin(x[own])
    return Model(lexicon, Trees().fit(x, y), isotonic(margin, y), float(y.mean()))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """id, score of each row by its whole text."""
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # trees and at most `entries` lexicon entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(held.value.lexicon)
        for whole in batches:
            for i in range(0, len(whole), 512):
                b = whole.slice(i, 512)
                x = np.array([measure(t.as_py()) for t in b.column(1)]).reshape(len(b), len(FEATURES))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.scores(x), pa.float64())], ["id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    held_out marks rows whose crc32(doc_id as text) mod 5 is 0; their labels are never read. Null ids are not held
    out. Null, empty and blank texts are scored as texts without words. Repeated rows get equal scores. Columns beside
    doc_id and text are never read.
    """
    score = scored(docs, fit(docs, labels, label_col, sample_rows))
    out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score.select(F.col("id").alias("doc_id"), out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
