"""Chat transcripts: a hidden Markov model recovers who speaks, line by line, before turns are rendered one way.

States are the first and the further lines of a turn of each role. A line is observed by its speaker marker and by
features of the line (length, end, opening). Counts over all labelled transcripts give the model; Viterbi finds the
best roles. A transcript is cut into segments of SEGMENT turns of input; each segment's best-path scores between all
states (a matrix) are found on their own, the matrices of a transcript are joined in order, and then each segment is
decoded between the states it starts after and ends in: the result is that of one long Viterbi run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seshat.llm._io import groups, settle

ROLES = ("system", "user", "assistant")
# Names that stand before a speaker's words.
NAMES = {
    "system": ("system", "sys", "context", "setup"),
    "user": ("user", "human", "customer", "question", "q", "prompter", "me", "instruction"),
    "assistant": ("assistant", "ai", "bot", "model", "answer", "a", "response", "agent"),
}
ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
MARKER = re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*(?P<angle>[A-Za-z]{1,12})\s*(?:\|>)?|#{2,}\s*(?P<hash>[A-Za-z]{1,12})\s*:?|\[(?P<square>[A-Za-z]{1,12})\]\s*:?|\*\*(?P<star>[A-Za-z]{1,12})\s*:?\*\*:?|(?P<plain>[A-Za-z]{1,12})\s*(?::|>))[ \t]*")
STATES, SEGMENT = 2 * len(ROLES), 512
#: Values of each feature of a line: marker, length, end, opening.
WIDTHS = (5, 12, 5, 4)


def observe(line: str) -> tuple[tuple[int, ...], str]:
    """Features of a line, and the line without its marker."""
    m, marker = MARKER.match(line), 0
    if m:
        name = next(g for g in m.groups() if g).lower()
        marker = ROLE_OF[name] + 1 if name in ROLE_OF else 4
        if marker < 4:
            line = line[m.end() :]
    body = line.strip()
    end = 0 if not body else 1 if body[-1] in ".!" else 2 if body[-1] == "?" else 3 if body[-1] in ":,;" else 4
    first = 0 if not body else 1 if body[0].isupper() else 2 if body[0].islower() else 3
    return (marker, min(len(body).bit_length(), WIDTHS[1] - 1), end, first), line


class Hmm:
    """Log probabilities: start[s], move[s, t], and for each feature see[f][s, value]."""

    def __init__(self, start: np.ndarray, move: np.ndarray, see: list[np.ndarray]):
        self.start, self.move, self.see = start, move, see

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, see: list[np.ndarray]) -> Hmm:
        first = np.arange(STATES) < len(ROLES)
        log = lambda c, allowed: np.where(allowed, np.log((c + 0.5) / np.maximum(1e-9, ((c + 0.5) * allowed).sum(-1, keepdims=True))), -1e9)
        own = np.zeros((STATES, STATES), bool)
        own[:, : len(ROLES)] = True
        for s in range(STATES):
            own[s, len(ROLES) + s % len(ROLES)] = True  # a further line belongs to the role of the line before
        return cls(log(start, first), log(move, own), [log(c, np.ones_like(c, bool)) for c in see])

    def emit(self, seen: np.ndarray) -> np.ndarray:
        return sum(e[:, seen[:, f]].T for f, e in enumerate(self.see))

    def matrix(self, seen: np.ndarray, first: bool) -> np.ndarray:
        """Best scores from each state before the lines (row 0 alone at a transcript's start) to each at their end."""
        e = self.emit(seen)
        m = np.full((STATES, STATES), -np.inf)
        if first:
            m[0] = self.start + e[0]
        else:
            m = self.move + e[0]
        for x in e[1:]:
            m = (m[:, :, None] + self.move[None]).max(1) + x
        return m

    def decode(self, seen: np.ndarray, before: int, last: int) -> np.ndarray:
        """The best states, after state `before` (-1: at the start), ending in state `last`."""
        e = self.emit(seen)
        v = (self.start if before < 0 else self.move[before]) + e[0]
        back = np.zeros((len(e), STATES), np.int64)
        for i in range(1, len(e)):
            step = v[:, None] + self.move
            back[i] = step.argmax(0)
            v = step.max(0) + e[i]
        path = np.zeros(len(e), np.int64)
        path[-1] = last
        for i in range(len(e) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def lined(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, text and any others) cut into segments, for sorted runs of (conv_id, segment)."""
    t = turns.where(F.col("conv_id").isNotNull()).withColumn("conv_id", F.col("conv_id").cast("long"))
    return t.withColumn("turn", F.coalesce(F.col("turn").cast("long"), F.lit(0))).withColumn("segment", F.floor(F.col("turn") / SEGMENT).cast("long")).withColumn("text", F.coalesce("text", F.lit("")))


def _runs(df: DataFrame) -> DataFrame:
    return df.withColumn("run", F.xxhash64("conv_id", "segment")).repartition("run").sortWithinPartitions("run", "turn", "text")


def _lines(texts: pd.Series) -> list[str]:
    return [x for t in texts for x in (t.split("\n") if t else [""])]


def fit(labelled: DataFrame) -> Hmm:
    """The model from all transcripts whose roles are known: conv_id, turn, role, text, one row a turn.

    Only counts of a fixed size leave the tasks. Roles that are not in ROLES are left out.
    """
    size = STATES + STATES * STATES + STATES * sum(WIDTHS)
    roles = {r: k for k, r in enumerate(ROLES)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, move, see = np.zeros(STATES), np.zeros((STATES, STATES)), [np.zeros((STATES, w)) for w in WIDTHS]
        for g in groups(batches, "run"):
            last = -1
            for role, text in zip(g.role, g.text):
                for i, line in enumerate(text.split("\n")):
                    s = roles[role] + (len(ROLES) if i else 0)
                    for f, v in enumerate(observe(line)[0]):
                        see[f][s, v] += 1
                    if last < 0:
                        start[s] += g.segment.iloc[0] == 0
                    else:
                        move[last, s] += 1
                    last = s
        every = np.concatenate([start, move.ravel(), *(x.ravel() for x in see)])
        at = np.flatnonzero(every)
        yield pd.DataFrame({"at": at, "n": every[at]})

    rows = _runs(lined(labelled.where(F.col("role").isin(*ROLES)).select("conv_id", "turn", "role", "text")))
    got = rows.mapInPandas(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    every = np.zeros(size)
    every[got["at"].to_numpy(np.int64)] = got.n
    cuts = np.cumsum([STATES, STATES * STATES, *(STATES * w for w in WIDTHS)])
    start, move, *see = np.split(every, cuts[:-1])
    return Hmm.from_counts(start, move.reshape(STATES, STATES), [x.reshape(STATES, w) for x, w in zip(see, WIDTHS)])


def parse(transcripts: DataFrame, model: Hmm) -> DataFrame:
    """conv_id, turn (from 0), role, rendered, n_lines of each recovered turn.

    transcripts: conv_id, turn (order of the text's parts), text: the parts of a raw transcript, of one or more lines.
    Roles are system, user or assistant: lines of any other speaker go to the one of the three they are most like. A
    turn is rendered as <|role|>, its lines without speaker markers, <|end|>. Null texts count as one empty line;
    null turns come first; equal turns are taken in order of their texts; rows with a null conv_id are left out, as no
    transcript can be told from another. An empty table gives an empty result. Other columns are left out.
    """
    rows = lined(transcripts.select("conv_id", "turn", "text"))
    firsts = rows.groupBy("conv_id").agg(F.min("segment").alias("start"))
    rows = settle(rows.join(firsts, "conv_id").withColumn("first", F.col("segment") == F.col("start")).drop("start"))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in groups(batches, "run"):
            seen = np.array([observe(x)[0] for x in _lines(g.text)])
            out.append((int(g.conv_id.iloc[0]), int(g.segment.iloc[0]), model.matrix(seen, bool(g["first"].iloc[0])).ravel().tolist()))
        yield pd.DataFrame(out, columns=["conv_id", "segment", "m"])

    def path(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Before and last state of each segment, over the segments of one transcript in order."""
        out = []
        for g in groups(batches, "conv_id"):
            ms = [np.array(m).reshape(STATES, STATES) for m in g.m]
            v, back = ms[0][0], []
            for m in ms[1:]:
                step = v[:, None] + m
                back.append(step.argmax(0))
                v = step.max(0)
            last = [int(v.argmax())]
            for b in reversed(back):
                last.append(int(b[last[-1]]))
            last.reverse()
            out += zip(g.conv_id, g.segment, [-1, *last[:-1]], last)
        yield pd.DataFrame(out, columns=["conv_id", "segment", "before", "last"])

    ends = _runs(rows).mapInPandas(matrices, "conv_id long, segment long, m array<double>")
    ends = settle(ends.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInPandas(path, "conv_id long, segment long, before int, last int"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in groups(batches, "run"):
            lines = [observe(x) for x in _lines(g.text)]
            states = model.decode(np.array([s for s, _ in lines]), int(g.before.iloc[0]), int(g["last"].iloc[0]))
            held: list[str] = []
            k, role = 0, states[0] % len(ROLES)
            for s, (_, line) in zip(states, lines):
                if s < len(ROLES):
                    if held:
                        out.append((g.conv_id.iloc[0], g.segment.iloc[0], k, ROLES[role], "\n".join(held), len(held)))
                    k, role, held = k + 1, s, []
                held.append(line)
            out.append((g.conv_id.iloc[0], g.segment.iloc[0], k, ROLES[role], "\n".join(held), len(held)))
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=["conv_id", "segment", "k", "role", "text", "n_lines"])
                out = []
        yield pd.DataFrame(out, columns=["conv_id", "segment", "k", "role", "text", "n_lines"])

    pieces = settle(_runs(rows.join(ends, ["conv_id", "segment"])).mapInPandas(decode, "conv_id long, segment long, k int, role string, text string, n_lines long"))
    counts = pieces.groupBy("conv_id", "segment").agg(F.max("k").alias("turns"))
    before = F.coalesce(F.sum("turns").over(W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.join(counts.withColumn("before", before), ["conv_id", "segment"]).withColumn("turn", F.col("before") + F.col("k") - 1)
    # a turn that runs on into further segments is put together
    whole = pieces.groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("segment", "text"))).alias("parts"), F.sum("n_lines").alias("n_lines"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return whole.select("conv_id", "turn", "role", F.concat(F.lit("<|"), "role", F.lit("|>\n"), text, F.lit("\n<|end|>")).alias("rendered"), "n_lines")


def as_transcripts(turns: DataFrame) -> DataFrame:
    """Turns with known roles as raw transcripts: each in one of five ways of marking speakers, some turns unmarked."""
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(5))
    bare = F.pmod(F.xxhash64(F.lit("bare"), "conv_id", "turn"), F.lit(8)) == 0
    name = F.when(F.col("role") == "user", F.element_at(F.array(*map(F.lit, ("User", "Human", "user", "Q", "USER"))), (style + 1).cast("int")))
    name = name.when(F.col("role") == "assistant", F.element_at(F.array(*map(F.lit, ("Assistant", "AI", "assistant", "A", "ASSISTANT"))), (style + 1).cast("int")))
    name = name.when(F.col("role") == "system", F.element_at(F.array(*map(F.lit, ("System", "System", "system", "Context", "SYSTEM"))), (style + 1).cast("int"))).otherwise(F.col("role"))
    mark = F.when(bare | F.col("role").isNull(), F.lit("")).when(style == 2, F.concat(F.lit("<|im_start|>"), name, F.lit("\n"))).when(style == 1, F.concat(F.lit("### "), name, F.lit(":\n"))).otherwise(F.concat(name, F.lit(": ")))
    return turns.withColumn("text", F.concat(mark, F.coalesce("text", F.lit(""))))
