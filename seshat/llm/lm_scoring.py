"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Every token is predicted from the two words before and the two after it: their vectors, one table for all, pass a
hidden layer, which gives a distribution over classes of words and, within the token's class, one over its words. The
most frequent words have a place in this tree, the first of them as classes of their own; all others form the last
class, in which a word has its corpus frequency. Every word is counted by its 64-bit hash in a table over all
documents; the counts of the words of the last class are joined to the tokens. A document's score is the sum of the
log probabilities of its tokens, each given all its neighbours; the same sum under the counts alone stands beside it.

All of the corpus is counted and learned from: documents are dealt over parts by hash, each part is learned from by
itself, starting from the same weights, and the weights are averaged by the number of tokens seen. The same documents
give the same scores on every cluster. The words that the network knows and its vectors follow the square root of the
vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seshat.llm._io import groups, settle
from seshat.llm._words import U, buffers, word_hashes

#: The least number, in bits, of words that the network knows and of context vectors.
LEAST_BITS = 13
#: Words that are classes of their own.
OWN = 40
#: Words counted at once, and the unit in which logarithms and weights are added, so that their order makes no difference.
COUNTED, UNIT = 1 << 20, float(1 << 32)
WIDTH, HIDDEN, BATCH, RATE = 12, 16, 8192, 0.1
#: Words gathered before a task learns from them, and words of a part that is learned from by itself.
GATHERED, PART = 65_536, 4_000_000
#: Weights sent in one row, and the unit in which weights times words are added.
BLOCK, SHARE = 16_384, float(1 << 12)
#: Words before and after the predicted one.
SIDES = (-2, -1, 1, 2)
#: Exponents up to here are taken as they are: no sum of them overflows, none that counts vanishes.
TAME = 50.0


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: how often each word (by its 64-bit hash) occurs over all texts."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        w, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, w in word_hashes(*buffers(batch.column(0))):
                held.append(w)
                n += len(w)
                if n >= COUNTED:
                    yield counted(held)
                    held, n = [], 0
        if n:
            yield counted(held)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Network:
    """Known words, their classes and weights; `least` is the count from which a word is known."""

    def __init__(self, counts: DataFrame):
        seen = sorted(((r.n, r.words) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
        total, distinct = sum(n * k for n, k in seen), sum(k for _, k in seen)
        self.bits = max(LEAST_BITS, int(np.ceil(np.log2(4 * max(1, distinct) ** 0.5))))
        self.least, held = seen[0][0] + 1 if seen else 1, 0
        for n, k in seen:
            if held + k > 1 << self.bits:
                break
            self.least, held = n, held + k
        head = counts.where(F.col("n") >= self.least).toPandas()
        words, n = head["word"].to_numpy(np.int64).view(U), head["n"].to_numpy(np.int64)
        order = np.lexsort((words, -n))
        words, n = words[order], n[order]
        # after the words of their own, classes whose sizes rise evenly: what is frequent stands in small ones
        more = max(0, len(n) - OWN)
        groups = max(1, int((more / 8) ** 0.5))
        ends = np.minimum(more, np.ceil(more * np.cumsum(np.arange(1, groups + 1)) / (groups * (groups + 1) / 2))).astype(np.int64)
        first = np.concatenate([np.arange(min(OWN, len(n))), OWN + np.concatenate([[0], ends[:-1]])[: groups if more else 0], [len(n)]]).astype(np.int64)
        self.first = np.append(np.unique(first), len(n) + 1)  # where each class begins; the last holds the words not known
        share = np.append(n + 0.5, max(total - n.sum(), 0) + 0.5 * (distinct - len(n) + 1)) if len(n) or total else np.ones(1)
        many = len(self.first) - 1
        self.classes = np.repeat(np.arange(many, dtype=np.uint16 if many < 1 << 16 else np.int64), np.diff(self.first))  # 16 bits are sorted by radix
        of_class = np.bincount(self.classes, share)
        order = np.argsort(words)
        self.words, self.place = words[order], np.append(order, len(words))
        self.unigram = np.log(share / share.sum())
        #: What the count of a word of the last class is divided by.
        self.rest = float(np.log(share[-1]))
        self.shapes = {"vectors": ((1 << self.bits) + 1, WIDTH), "w1": (len(SIDES) * WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, len(of_class)), "b2": (len(of_class),), "u": (len(share), HIDDEN), "c": (len(share),)}
        rng = np.random.default_rng(2)
        self.weights = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in self.shapes.items()}
        self.weights["b1"][:] = 0
        self.weights["u"][:] = 0
        self.weights["b2"] = np.log(of_class / of_class.sum()).astype(np.float32)
        self.weights["c"] = np.log(share / of_class[self.classes]).astype(np.float32)

    def start(self) -> None:
        """Sums of squared gradients, which set the steps."""
        self.squares = {k: np.full(s if k in ("w1", "w2", "b1", "b2", "c") else s[:1], 1e-3, np.float32) for k, s in self.shapes.items()}

    def places(self, words: np.ndarray) -> np.ndarray:
        """The rank of each word by frequency; one past all of them if it isn't known."""
        if not hasattr(self, "slot"):
            self.slots()
        at = self.slot.take((words >> self.shift).view(np.int64))
        for _ in range(self.longest):
            at += self.ended.take(at) < words
        return np.where(self.ended.take(at) == words, self.place.take(at), len(self.words))

    def slots(self) -> None:
        """Where the known words of each slot begin; a slot holds hashes of equal leading bits, so that few words are in one."""
        self.shift = U(64 - self.bits - 4)
        at = np.searchsorted(self.words, np.arange(1 << (self.bits + 4), dtype=U) << self.shift)
        self.slot, self.longest = at.astype(np.int32), int(np.diff(at, append=len(self.words)).max())
        self.ended = np.append(self.words, ~U(0))

    def forward(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden layer with a column of ones, shares of classes and what each row of them adds up to."""
        w = self.weights
        x = w["vectors"].take(near, axis=0).reshape(len(near), -1)
        h = np.ones((len(near), HIDDEN + 1), np.float32)
        np.tanh(x @ w["w1"] + w["b1"], out=h[:, :-1])
        return x, h, *_shares(h @ np.vstack([w["w2"], w["b2"]]), _tame(w["w2"].T, w["b2"], np.zeros(1, np.int64)))

    def inside(self, h: np.ndarray, classes: np.ndarray) -> Iterator[tuple[int, int, slice, np.ndarray, np.ndarray]]:
        """(first word, last, rows, shares, their sums) for each class of several words that rows are in; rows come by class."""
        w = self.weights
        tame = _tame(w["u"], w["c"], self.first[:-1])
        u = np.column_stack([w["u"], w["c"]])
        cut = np.concatenate([[0], np.flatnonzero(classes[1:] != classes[:-1]) + 1, [len(classes)]])
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            a, b = self.first[classes[i]], self.first[classes[i] + 1]
            if b - a > 1:
                yield a, b, slice(i, j), *_shares(h[i:j] @ u[a:b].T, tame)

    def learn(self, near: np.ndarray, places: np.ndarray) -> None:
        classes = self.classes.take(places)
        order = np.argsort(classes, kind="stable")
        near, places, classes = near.take(order, axis=0), places.take(order), classes.take(order)
        w = self.weights
        x, h, p, sums = self.forward(near)
        # shares less their sum at what was to be predicted; the sums are divided by where rows are shortest
        p.ravel()[_cells(p, classes)] -= sums
        part = 1 / sums
        dh = (p @ w["w2"].T) * part[:, None]
        gradients = {"w2": (h[:, :-1] * part[:, None]).T @ p, "b2": part @ p}
        # what no row is about has gradients 0, which change nothing
        gradients |= {"u": np.zeros_like(w["u"]), "c": np.zeros_like(w["c"])}
        for a, b, at, q, sums in self.inside(h, classes):
            q.ravel()[_cells(q, places[at] - a)] -= sums
            part = 1 / sums
            dh[at] += (q @ w["u"][a:b]) * part[:, None]
            gradients["u"][a:b] = q.T @ (h[at, :-1] * part[:, None])
            gradients["c"][a:b] = part @ q
        dh *= 1 - h[:, :-1] ** 2
        dx = (w["w1"] @ dh.T).reshape(len(SIDES), WIDTH, -1)
        at = near.T.ravel().astype(np.int64)
        gradients["vectors"] = np.stack([np.bincount(at, dx[:, k].ravel(), len(w["vectors"])) for k in range(WIDTH)], 1).astype(np.float32)
        gradients |= {"w1": x.T @ dh, "b1": np.ones(len(dh), np.float32) @ dh}
        for name, g in gradients.items():
            self._step(name, g)

    def _step(self, name: str, g: np.ndarray) -> None:
        """A step against the gradient, over the root of the squares so far; of a word's vector as a whole."""
        s, w = self.squares[name], self.weights[name]
        if s.ndim < g.ndim:
            s += np.einsum("ij,ij->i", g, g) / g.shape[1]
            g *= (RATE / np.sqrt(s))[:, None]
        else:
            s += g * g
            g *= RATE / np.sqrt(s)
        w -= g

    def log_probabilities(self, near: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of each token; of a word that isn't known, of the last class over its total count."""
        classes = self.classes.take(places)
        order = np.argsort(classes, kind="stable")
        near, places, classes = near.take(order, axis=0), places.take(order), classes.take(order)
        _, h, p, sums = self.forward(near)
        out = np.log(np.maximum(p.take(_cells(p, classes)) / sums, 1e-12)).astype(np.float64)
        for a, _, at, q, sums in self.inside(h, classes):
            out[at] += np.log(np.maximum(q.take(_cells(q, places[at] - a)) / sums, 1e-12))
        out[places == len(self.words)] -= self.rest
        back = np.empty_like(out)
        back[order] = out
        return back


def _cells(z: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Where the cell of each row of z that is in the row's column stands in z as one row."""
    return np.arange(0, z.size, z.shape[1]) + columns


def _tame(w: np.ndarray, c: np.ndarray, first: np.ndarray) -> bool:
    """Whether products of w with values in [-1, 1], plus c, stay below TAME, and in each class from `first` on one stays above -TAME."""
    reach = np.abs(w) @ np.ones(w.shape[1], np.float32)
    return bool((c + reach).max() < TAME and np.maximum.reduceat(c - reach, first).min() > -TAME)


def _shares(z: np.ndarray, tame: bool) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) in place, but for a factor a row where z isn't tame, and what each row adds up to."""
    if not tame:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], np.float32)


def windows(words: np.ndarray, bits: int, sizes: list[int] | None = None) -> np.ndarray:
    """The context types around each word, one past them where the text has ended; words are of texts of such sizes, or of one."""
    sizes = np.array([len(words)] if sizes is None else sizes, np.int64)
    at = np.arange(len(words)) + np.repeat(2 * np.arange(1, len(sizes) + 1), sizes)  # two places between texts
    pad = np.full(len(words) + 2 * len(sizes) + 2, 1 << bits, np.int32)
    pad[at] = words >> U(64 - bits)
    near = np.empty((len(words), len(SIDES)), np.int32)
    for k, s in enumerate(SIDES):
        near[:, k] = pad.take(at + s)
    return near


def _gathered(batches: Iterator[pa.RecordBatch], column: int, least: int, bits: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(number of words of each text, windows, words) for runs of whole texts of some `least` words."""

    def run() -> tuple[list[int], np.ndarray, np.ndarray]:
        sizes, whole = [len(w) for w in held], np.concatenate(held)
        return sizes, windows(whole, bits, sizes), whole

    held, n = [], 0
    for batch in batches:
        for _, w in word_hashes(*buffers(batch.column(column))):
            held.append(w)
            n += len(w)
            if n >= least:
                yield run()
                held, n = [], 0
        if held and column:
            yield run()
            held, n = [], 0
    if held:
        yield run()


def trained(docs: DataFrame, counts: DataFrame, text_col: str = "text", part_words: int = PART) -> Network:
    """The network after one pass over all texts; counts are the word_counts of docs.

    Texts are dealt by their hash over parts of some `part_words` words, in the order of the hash. A third of all rows
    may be one text: copies of it are dealt on over all parts by their ids. The parts' weights are added up in blocks
    of BLOCK, first those of some parts and then all of them, in whole units.
    """
    network = Network(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // part_words))
    held = docs.sparkSession.sparkContext.broadcast(network)
    shapes = network.shapes
    salts = int(np.ceil(parts**0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = held.value
        start = net.weights  # a worker may run several tasks on the one network it was sent
        net.weights = {k: v.copy() for k, v in start.items()}
        net.start()
        seen = 0
        for _, near, words in _gathered(batches, 0, GATHERED, net.bits):
            places, rng = net.places(words), np.random.default_rng([seen, len(words)])
            order = rng.permutation(len(words))
            for i in range(0, len(order), BATCH):
                at = order[i : i + BATCH]
                net.learn(near.take(at, axis=0), places.take(at))
            seen += len(words)
        flat = np.concatenate([net.weights[k].ravel() for k in shapes])
        net.weights = start
        if seen:
            at = np.arange(0, len(flat), BLOCK)
            salt = np.full(len(at), int(np.random.default_rng([seen, len(words)]).integers(1 << 30)) % salts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(salt, pa.int64()), pa.array([flat[i : i + BLOCK].tobytes() for i in at], pa.binary()), pa.array(np.full(len(at), seen))], ["at", "salt", "w", "n"])

    def added(first: bool) -> Callable:
        """Sums of weights times words, in whole units, over the rows of a block; the first sums are of single weights."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in groups(batches, *(["at", "salt"] if first else ["at"])):
                total = 0
                for w, n in zip(g.w, g.n):
                    total = total + (np.round(np.frombuffer(w, np.float32).astype(np.float64) * n * SHARE).astype(np.int64) if first else np.frombuffer(w, np.int64))
                yield pd.DataFrame({"at": g["at"].iloc[:1], "salt": g["salt"].iloc[:1], "w": [total.tobytes()], "n": [g.n.sum()]})

        return run

    key = F.xxhash64(F.lit(3), text_col, *(c for c in docs.columns if c != text_col and c == "doc_id"))
    rows = docs.select(F.col(text_col).alias("text"), key.alias("key")).where("text is not null")
    schema = "at long, salt long, w binary, n long"
    rows = rows.repartition(parts, "key").sortWithinPartitions("key").select("text").mapInArrow(run, schema)
    rows = rows.repartition("at", "salt").sortWithinPartitions("at", "salt").mapInPandas(added(True), schema)
    got = rows.repartition("at").sortWithinPartitions("at").mapInPandas(added(False), schema).toPandas().sort_values("at")
    if len(got):
        flat = np.concatenate([np.frombuffer(w, np.int64) / (n * SHARE) for w, n in zip(got.w, got.n)])
        cuts = np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1]
        network.weights = {k: p.reshape(s).astype(np.float32) for (k, s), p in zip(shapes.items(), np.split(flat, cuts))}
    return network


def pseudo_likelihood(docs: DataFrame, network: Network, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_probability, unigram_log_likelihood of each row.

    They are given by the network and by the counts it was made of. Null, empty and blank texts have no words,
    likelihoods 0 and a null mean. Repeated rows get equal scores but for rounding (single precision), null ids are kept. Texts are read whole, whatever
    their length. Other columns are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = held.value
        for batch in batches:
            start = 0
            for sizes, near, words in _gathered(iter([batch]), 2, GATHERED // 4, net.bits):
                places = net.places(words)
                logs = [net.log_probabilities(near[i : i + 8192], places[i : i + 8192]) for i in range(0, len(places), 8192)]
                rare = places == len(net.words)
                alone = net.unigram[places]
                alone[rare] -= net.rest
                n = np.array(sizes, np.int64)
                end = np.cumsum(n)
                sums = [(s := np.concatenate([[0.0], np.cumsum(x)]))[end] - s[end - n] for x in (np.concatenate(logs) if logs else np.empty(0), alone)]
                cuts = np.concatenate([[0], np.cumsum(rare)])[np.concatenate([[0], end])]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(words[rare].view(np.int64)))
                row, ids = batch.column(0).slice(start, len(n)), batch.column(1).slice(start, len(n))
                yield pa.RecordBatch.from_arrays([row, ids, pa.array(n), *map(pa.array, sums), lists], ["row", "doc_id", "n_words", "known", "alone", "rare"])
                start += len(n)

    # rows are numbered once and for all by writing them: ids may be null or repeated
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = settle(rows.mapInArrow(run, "row long, doc_id long, n_words long, known double, alone double, rare array<long>"))
    rare = parts.select("row", F.explode("rare").alias("word")).join(counts.where(F.col("n") < network.least), "word", "left")
    log = F.round(F.log(F.coalesce("n", F.lit(0)) + 0.5) * UNIT).cast("long")
    added = rare.groupBy("row").agg(F.sum(log).alias("added"))
    both = [(F.col(c) + F.coalesce("added", F.lit(0)) / UNIT).alias(name) for c, name in (("known", "log_likelihood"), ("alone", "unigram_log_likelihood"))]
    out = parts.drop("rare").join(added, "row", "left").select("doc_id", "n_words", *both)
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return out.select("doc_id", "n_words", "log_likelihood", mean.alias("mean_log_probability"), "unigram_log_likelihood")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pseudo_likelihood of docs under a network trained on docs; an empty table gives an empty result."""
    counts = settle(word_counts(docs, text_col))
    return pseudo_likelihood(docs, trained(docs, counts, text_col), counts, id_col, text_col)
