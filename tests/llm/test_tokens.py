"""Token counts at every prefix of op10 against the library."""

import base64
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seshat.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def fuzzed():
    rng = np.random.default_rng(7)
    letters = list("abcdefgh ABXYZ0123456789'''''..,!?-_&<|>  \t\nsltdmrve éÉüßñçИжΣσςİı漢字かな한글각 ̧́̈\xa0　각‍😀ﬁ")
    words = ["<|endoftext|>", "<|startoftext|>", "'ll", "'re", "unbelievable", "tokenization", "Straße", "é", "  ", "\U0001f468‍\U0001f469"]
    texts = ["Hello wörld, unbelievable tokenizations!! ok", "x<|endoftext|>y'll <|endoftext", "!!<|startoftext|>'s", "", " ", "caféş İstanbul ΣΑΣ"]
    return texts + ["".join(str(rng.choice(words if rng.random() < 0.15 else letters)) for _ in range(rng.integers(1, 30))) for _ in range(200)]


def test_every_prefix_equals_the_library():
    lib, ends = Tokenizer.from_file(PATH), token_counts.WordEnds(PATH)
    for text in fuzzed():
        want = [len(e.ids) for e in lib.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
        assert ends.table(text).tolist() == want, text


def test_long_pieces_take_time_in_proportion():
    lib, ends = Tokenizer.from_file(PATH), token_counts.WordEnds(PATH)
    rng = np.random.default_rng(3)
    for piece in (base64.b64encode(rng.bytes(45_000)).decode(), "".join(rng.choice(list("etaoinshrdlu"), 60_000))):
        ends.table(piece[:5000])
        start = time.time()
        got = ends.table(piece)
        assert time.time() - start < 30
        for k in (1, 999, 30_001, len(piece)):
            assert got[k] == len(lib.encode(piece[:k], add_special_tokens=False).ids)


def test_budgets_are_read_from_the_table(spark):
    rows = [(1, "Hello wörld, unbelievable  tokenizations!! ok", 1), (2, None, 2), (3, "", 3), (None, " 漢字 x ", 4)]
    tables = token_counts.prefix_tables(spark.createDataFrame(rows, "doc_id long, text string, counts int"), PATH).cache()
    lib = Tokenizer.from_file(PATH)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for budget in (0, 3, 100):
        got = {r.id: (r.text, r.n_tokens) for r in token_counts.truncated(tables, budget).collect()}
        for i, t, _ in rows:
            want = None if t is None else max(k for k in range(len(t) + 1) if count(t[:k]) <= budget)
            assert got[i] == ((None, None) if t is None else (t[:want], count(t[:want])))
    at = tables.where("id = 1").select(token_counts.count_at("counts", F.lit(13)).alias("n"), token_counts.count_at("counts", F.lit(999)).alias("none")).first()
    assert at.n == count(rows[0][1][:13]) and at.none is None
