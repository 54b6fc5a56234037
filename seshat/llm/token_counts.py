"""Exact token counts at every prefix of a text, for a public word-end BPE vocabulary.

The tokenizer cuts at white space before anything else, so the count of a prefix follows from the count of a shorter
one: P[0] = 0 and P[k] = P[k - 1] + c(piece k), where pieces are runs without ASCII white space and c is the
library's count of a piece by itself, kept per distinct piece. `prefixes` stores the ends of the pieces and P.

`prefix_tables` stores the count at every character. Inside a word it is a dynamic program too: every beginning of a
word has one last token, the one that stays beside the last token of what comes before it when the two are merged by
themselves; so the tokens of a beginning are those of a shorter one and one more, and a word is gone through once.
Counts, truncation and budgets are then read from the stored table by DataFrame functions; nothing is encoded again.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct pieces a task remembers; older ones are counted again.
REMEMBERED = 300_000


class Pieces:
    """The library's token counts of pieces of text, remembered."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}

    def learn(self, pieces: set[bytes]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(pieces)
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            got = self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in part], add_special_tokens=False)
            self.known.update(zip(part, map(len, got)))

    def count(self, piece: bytes) -> int:
        if piece not in self.known:
            self.learn({piece})
        return self.known[piece]


def _ends(text: bytes, pieces: list[bytes]) -> np.ndarray:
    """Where each piece ends, in bytes."""
    data = np.frombuffer(text, np.uint8)
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = (data != 32) & ((data < 9) | (data > 13))
    return np.flatnonzero(word[:-1] & ~word[1:]).astype(np.int32) + 1


def prefixes(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """id, n_bytes, ends array<int>, counts array<int> of each row: byte offsets where pieces end, tokens up to there.

    Null counts as empty; empty and blank texts have empty arrays. Special strings are what the library takes them
    for. Rows are independent: repeated rows and null ids are kept as they are. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(tokenizer_path)

        def out(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
            split = [t.split() for t in texts]
            pieces.learn(set().union(*split))
            known = pieces.known
            counts = [np.cumsum(np.fromiter(map(known.__getitem__, s), np.int32, len(s)), dtype=np.int32) for s in split]
            ends = [_ends(t, s) for t, s in zip(texts, split)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in split])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.empty(0, np.int32), pa.int32())) for x in (ends, counts)]
            return pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), *lists], ["id", "n_bytes", "ends", "counts"])

        for batch in batches:
            ids, column = batch.column(0), batch.column(1).cast(pa.large_binary()).fill_null(b"")
            start, texts, size = 0, [], 0
            for i, t in enumerate(column):
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= batch_bytes:
                    yield out(ids.slice(start, len(texts)), texts)
                    start, texts, size = i + 1, [], 0
            if texts:
                yield out(ids.slice(start, len(texts)), texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, ends array<int>, counts array<int>")


PIECE = re.compile(r"[^\x20\x09-\x0D]+")
#: White space as the vocabulary's patterns know it.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Longest word or piece whose table a task remembers.
SHORT = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be printed, else the next free one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in printed else chr(next(free)) for b in range(256)]


@cache
def _joining() -> frozenset[str]:
    """Characters that may be composed with the one before: marks, and second parts of canonical decompositions."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.combining(c):
            out.add(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def _low(text: str) -> str:
    return "".join(c.lower() for c in text)


class WordEnds:
    """Token counts of every beginning of a piece under a byte-level BPE with word ends, from its file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix")
        if not self.end or model["type"] != "BPE":
            raise ValueError(f"{path} holds no BPE with word ends")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ranks = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.vocabulary = set(model["vocab"])
        self.longest = max(map(len, self.vocabulary))
        self.letters = byte_letters()
        self.beside: dict[tuple[str, str], bool] = {}
        self.known: dict[str, np.ndarray] = {}
        self.pieces: dict[str, np.ndarray] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols with all merges done, the lowest rank first and the first place of equal ones."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def stays(self, before: str, token: str) -> bool:
        """Whether the two tokens (the first may be none) come out as they are when their symbols are merged."""
        pair = (before, token)
        if pair not in self.beside:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            self.beside[pair] = self.merged([*before, *self._symbols(token)]) == ([before, token] if before else [token])
        return self.beside[pair]

    def word(self, text: str) -> np.ndarray:
        """The tokens of text[:1], text[:2] and so on, each as a word of its own."""
        if (got := self.known.get(text)) is not None:
            return got
        data = text.encode("utf-8", "surrogatepass")
        w = "".join(self.letters[b] for b in data)
        n = len(w)
        last, count = [""] * (n + 1), [0] * (n + 1)  # of beginnings that go on
        out = []
        for e in range(1, n + 1):
            going, ended = 0, e < n and data[e] & 0xC0 == 0x80
            for size in range(min(self.longest, e), 0, -1):
                token = w[e - size : e]
                if not going and token in self.vocabulary and self.stays(last[e - size], token):
                    going = size
                if not ended and token + self.end in self.vocabulary and self.stays(last[e - size], token + self.end):
                    out.append(count[e - size] + 1)
                    ended = True
                if going and ended:
                    break
            last[e], count[e] = w[e - going : e], count[e - going] + 1
        counts = np.array(out, np.int32)
        if len(text) <= SHORT:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[text] = counts
        return counts

    def _sum(self, text: str) -> int:
        return sum(int(self.word(m.group())[-1]) for m in self.words.finditer(text))

    def _plain(self, text: str) -> np.ndarray:
        """The tokens of every beginning of a text without special strings and ASCII white space."""
        if text.isascii():
            clusters, parts = list(text), list(text.lower())
        else:
            joining = _joining()
            starts = [k for k, c in enumerate(text) if not k or c not in joining]
            clusters = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
            parts = [_low(unicodedata.normalize("NFC", c)) for c in clusters]
        whole = "".join(parts)
        total = np.zeros(len(whole) + 1, np.int32)  # of beginnings of the normal form
        start = np.arange(len(whole) + 1)  # where the last word of each begins
        done = base = 0
        for m in self.words.finditer(whole):
            a, b = m.span()
            total[done + 1 : a + 1] = base
            counts = self.word(whole[a:b])
            if whole[a] == "'" and b - a > 1:  # the beginnings of 'll and the like are other words
                counts = np.array([self._sum(whole[a : a + k]) if k < 3 else counts[k - 1] for k in range(1, b - a)] + [counts[-1]], np.int32)
            total[a + 1 : b + 1], start[a + 1 : b + 1] = base + counts, a
            base, done = int(total[b]), b
        total[done + 1 :] = base
        if len(whole) == len(text) == len(clusters):
            return total[1:]
        out, at, k = np.empty(len(text), np.int32), 0, 0
        for cluster, part in zip(clusters, parts):
            for size in range(1, len(cluster)):  # a cut inside a composed character: its last word by itself
                a = int(start[at])
                a = int(start[a]) if a and whole[a - 1] == "'" else a  # what follows may belong to it
                out[k] = total[a] + self._sum(whole[a:at] + _low(unicodedata.normalize("NFC", cluster[:size])))
                k += 1
            at += len(part)
            out[k] = total[at]
            k += 1
        return out

    def inside(self, piece: str) -> np.ndarray:
        """The tokens of every beginning of a piece, one character longer each."""
        if (got := self.pieces.get(piece)) is not None:
            return got
        out, base, at = [], 0, 0
        while True:
            found = [(k, -len(s), s) for s in self.special if (k := piece.find(s, at)) >= 0]
            if not found:
                out.append(self._plain(piece[at:]) + base)
                break
            k, _, s = min(found)
            # until its last character a special string is text like any other
            plain = self._plain(piece[at : k + len(s) - 1]) + base
            base = int(plain[k - at - 1] if k > at else base) + 1
            out += [plain, np.array([base], np.int32)]
            at = k + len(s)
        counts = np.concatenate(out)
        if len(piece) <= SHORT:
            if len(self.pieces) > REMEMBERED:
                self.pieces.clear()
            self.pieces[piece] = counts
        return counts

    def table(self, text: str) -> np.ndarray:
        """The tokens of text[:0], text[:1] and so on."""
        out, base, done = np.zeros(len(text) + 1, np.int32), 0, 0
        for m in PIECE.finditer(text):
            a, b = m.span()
            out[done : a + 1] = base
            out[a + 1 : b + 1] = base + self.inside(m.group())
            base, done = int(out[b]), b
        out[done:] = base
        return out


def prefix_tables(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, counts array<int> of each row: counts[j] is the number of tokens of the first j characters.

    A null text has null counts, an empty one a single 0. Repeated rows and null ids are kept as they are. Other
    columns are left out. A word's table takes time in proportion to its length; only a cut between a letter and a
    mark that is composed with it is counted from the start of its word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = WordEnds(tokenizer_path)
        for batch in batches:
            start, held, size = 0, [], 0
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                held.append(None if t is None else ends.table(t))
                size += len(t or "")
                if size >= 1 << 20 or i == len(batch) - 1:
                    part = batch.slice(start, len(held))
                    cuts = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in held])])
                    values = np.concatenate([np.empty(0, np.int32), *(x for x in held if x is not None)])
                    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()), mask=pa.array([x is None for x in held]))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["id", "text", "counts"])
                    start, held, size = i + 1, [], 0

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text string, counts array<int>")


def count_at(counts: Column | str, characters: Column) -> Column:
    """Tokens of the first characters of a text, from its table; null beyond its end."""
    return F.get(counts, characters)


def longest_within(counts: Column | str, budget: Column | int) -> Column:
    """How many characters the longest beginning of at most `budget` tokens has; null without a table."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    at = F.array_position(F.transform(F.reverse(counts), lambda c: c <= most), F.lit(True))
    return F.when(at > 0, F.size(counts) - at).cast("int")


def truncated(tables: DataFrame, budget: int) -> DataFrame:
    """id, text cut to its longest beginning of at most `budget` tokens, n_tokens of it, from prefix_tables.

    A null text stays null and has null tokens; an empty one has 0.
    """
    t = tables.withColumn("keep", longest_within("counts", budget))
    return t.select("id", F.left("text", F.col("keep")).alias("text"), count_at("counts", F.col("keep")).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row, read off its prefixes."""
    n = F.coalesce(F.try_element_at("counts", F.lit(-1)), F.lit(0)).cast("long")
    return prefixes(docs, tokenizer_path, id_col, text_col).select(F.col("id").alias("doc_id"), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
