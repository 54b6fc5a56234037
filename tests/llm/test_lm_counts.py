"""Word counts of op2 are exact, whatever the size of the vocabulary."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa

from seshat.llm import lm_scoring
from seshat.llm._words import buffers, word_hashes


def test_counts_tell_every_word_apart(spark):
    words = [f"w{i}" for i in range(150_000)]
    rows = [(i, " ".join(words[i : i + 1000])) for i in range(0, len(words), 1000)] + [(-1, " ".join(["often"] * 7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm_scoring.word_counts(docs)
    assert {(r.n, r["count"]) for r in counts.groupBy("n").count().collect()} == {(1, 150_000), (7, 1)}
    network = lm_scoring.Network(counts)
    assert network.least == 7 and len(network.words) == 1


def test_rare_words_are_scored_by_their_own_count(spark):
    # two texts of equal contexts: the words of one occur once, those of the other twice; too many words occur thrice
    filler = " ".join(f"w{i}" for i in range(9000))
    rows = [(0, " ".join(["the"] * 50)), (1, "once"), (2, "twice"), (3, "twice"), (4, filler), (None, filler), (6, filler), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.scored(docs).collect()}
    assert got[2].log_likelihood == got[3].log_likelihood and got[5].log_likelihood == 0
    for column in ("log_likelihood", "unigram_log_likelihood"):
        assert math.isclose(got[2][column] - got[1][column], math.log(2.5 / 1.5), abs_tol=1e-6)
    assert len(got) == 8 and got[None].n_words == 9000


def test_a_part_is_learned_from_once(spark):
    text = "a b c d e f " * 20
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    counts = lm_scoring.word_counts(docs)
    got, want = lm_scoring.trained(docs, counts), lm_scoring.Network(counts)
    words = next(word_hashes(*buffers(pa.array([text]))))[1]
    at = np.random.default_rng([0, len(words)]).permutation(len(words))
    want.start()
    want.learn(lm_scoring.windows(words, want.bits)[at], want.places(words)[at])
    assert all(np.allclose(got.weights[k], want.weights[k], atol=1e-5) for k in want.weights)


def small(rng, n, known=30):
    """A network of `known` words whose classes hold one or several, after some steps."""
    class Counts:
        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return self

        def collect(self):
            return [type("R", (), {"n": int(k), "words": 1}) for k in range(1, known + 1)]

        def where(self, _):
            return self

        def toPandas(self):
            return pd.DataFrame({"word": np.arange(known) * 7 + 3, "n": np.arange(known) + 1})

    net = lm_scoring.Network(Counts())
    net.start()
    words = (rng.integers(0, known + 5, n) * 7 + 3).astype(np.uint64)
    near = rng.integers(0, 1 << net.bits, (n, 4))
    for _ in range(5):
        net.learn(near, net.places(words))
    return net, near, net.places(words)


def test_probabilities_add_up_to_one_and_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "OWN", 4)
    net, near, places = small(np.random.default_rng(0), 60)
    assert len(net.first) - 1 < 30  # some classes hold several words
    w = net.weights
    for row, place in zip(near[:20], places[:20]):
        h = np.tanh(np.concatenate([w["vectors"][k] for k in row]) @ w["w1"] + w["b1"])
        z = np.exp(h @ w["w2"] + w["b2"])
        logs = []
        for v in range(31):
            c = net.classes[v]
            mates = [m for m in range(31) if net.classes[m] == c]
            y = {m: np.exp(h @ w["u"][m] + w["c"][m]) for m in mates}
            logs.append(np.log(z[c] / z.sum() * y[v] / sum(y.values())))
        assert math.isclose(sum(np.exp(logs)), 1, abs_tol=1e-5)
        got = net.log_probabilities(row[None], np.array([place]))[0]
        assert math.isclose(got + (net.rest if place == 30 else 0), logs[place], abs_tol=1e-4)


def test_held_out_text_is_predicted_better_than_by_counts(spark):
    """Of two languages, the words of each are told from their neighbours, inside the classes too."""
    rng = np.random.default_rng(4)
    tongues = [[f"{c}{i}" for i in range(150)] for c in "xy"]
    rows = [(i, " ".join(rng.choice(tongues[i % 2], 200))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = docs.where("doc_id % 5 <> 0")
    counts = lm_scoring.word_counts(known)
    network = lm_scoring.trained(known, counts)
    got = lm_scoring.pseudo_likelihood(docs.where("doc_id % 5 = 0"), network, counts).collect()
    words = sum(r.n_words for r in got)
    assert len(got) == 120 and sum(r.log_likelihood - r.unigram_log_likelihood for r in got) / words > 0.4
