"""Personal data in texts: e-mail addresses, IP addresses, card and phone numbers, plain and disguised.

Plain identifiers are found in the text as it stands. Disguised ones are found in a normalised text that three
transducers make one after the other: look-alike and invisible characters, spelled digits, written at and dot signs.
Each keeps its edits, so a span of the normalised text is carried back through them to the characters it came from.
Every step is linear in the text, whatever it holds; texts are taken whole, each by itself, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones, and number words of four languages.
LOOKALIKES = dict(zip("АВЕКМНОРСТУХІЈЅаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιαρνυ", "ABEKMHOPCTYXIJSaeopcyxijsdhqwABEZHIKMNOPTYXoiapvu"))
NUMBERS = (
    "zero null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf cinq cinco", "six sechs six seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
)
DIGIT_OF = {word: str(n) for n, words in enumerate(NUMBERS) for word in words.split()}


def emails(s: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain: the local part is what stands before the @ since the last match."""
    out, end = [], 0
    for m in DOMAIN.finditer(s):
        at = start = m.start()
        while start > end and s[start - 1] in LOCAL:
            start -= 1
        if start < at:
            out.append((start, end := m.end()))
    return out


def ips(s: str) -> list[tuple[int, int]]:
    """Fours of dotted numbers, from the left of each dotted run; those with a part over 255 are dropped."""
    out = []
    for m in DOTTED.finditer(s):
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def cards(s: str) -> list[tuple[int, int]]:
    spans = ((m.span(), m[0].replace(" ", "").replace("-", "")) for m in CARD.finditer(s))
    return [span for span, digits in spans if 14 <= len(digits) <= 19 and luhn(digits)]


def phones(s: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(s) if 10 <= sum(map(str.isdigit, m[0])) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))


def plain(s: str) -> list[Span]:
    """(start, end, kind) of the identifiers that stand in the text as they are."""
    return [(a, b, kind) for kind, find in FINDERS.items() for a, b in find(s)]


class Rewritten:
    """A text made from another by edits, each (start, end, new text), in order and apart from one another."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        parts, self.starts, self.ends, self.back = [], [], [], []
        at = length = 0
        for a, b, new in edits:
            parts += [source[at:a], new]
            length += a - at
            self.starts.append(length)
            length += len(new)
            self.ends.append(length)
            self.back.append((a, b))
            at = b
        self.text = "".join([*parts, source[at:]]) if edits else source

    def _at(self, place: int, after: int) -> int:
        """Where the character at place came from: its beginning, or its end if `after` is 1."""
        k = bisect_right(self.starts, place) - 1
        if k < 0:
            return place + after
        return self.back[k][after] if place < self.ends[k] else self.back[k][1] + place - self.ends[k] + after

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self._at(start, 0), self._at(end - 1, 1)


def _plain_character(c: str) -> str | None:
    """The ASCII character that c stands for, '' for one that cannot be seen, None for any other."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (digit := unicodedata.digit(c, None)) is not None:
        return str(digit)
    if (kind := unicodedata.category(c)) in ("Cf", "Zs", "Pd"):
        return {"Cf": "", "Zs": " ", "Pd": "-"}[kind]
    same = unicodedata.normalize("NFKC", c)
    return same if len(same) == 1 and same.isascii() else None


@cache
def known_characters() -> tuple[re.Pattern, dict[str, str]]:
    """What _plain_character says, over the planes that hold letters, digits and signs; and a pattern of what it may speak of."""
    known = {c: new for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x1FC00)]) if (new := _plain_character(c)) is not None}
    return re.compile("[" + "".join(c for c in known if c < "\U00010000") + "\U00010000-\U0001fbff]"), known


WORDS = re.compile(r"[^\W\d_]+")
SPOKEN = {*DIGIT_OF, "oh", "plus"}
SIGNS = re.compile(r"(?i)\b(?:at|arroba|dot|punkt|point|punto)\b|[@.](?=\s{0,8}[)\]}>])|@|&#?\w{2,9};")
ENTITY = re.compile(r"&(?:(#0{0,4}64|#x0{0,4}40|commat)|#0{0,4}46|#x0{0,4}2e|period);")
#: What may stand for an at or a dot, and what stands for it without brackets around it.
AT, DOT, BARE = {"@", "at", "arroba"}, {".", "dot", "punkt", "point", "punto"}, {"at", "dot", "punkt", "punto"}
DOT_BEFORE = re.compile(r"(?i)(?<![a-z])(?:dot|punkt|punto)\s*[)\]}>]?\Z|[(\[{<]\.[)\]}>]\Z")
DOT_BEHIND = re.compile(r"(?i)[(\[{<]?\s*(?:dot|punkt|punto)(?![a-z])|[(\[{<]\.[)\]}>]")
SPACED_DIGIT = re.compile(r"\s{1,8}(?=[0-9])")
ARTICLES = {"the", "this", "that", "an"}
NAME = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")


def characters(s: str) -> Rewritten:
    if s.isascii():
        return Rewritten(s, [])
    pattern, known = known_characters()
    return Rewritten(s, [(m.start(), m.end(), new) for m in pattern.finditer(s) if (new := known.get(m[0])) is not None])


def digits(s: str) -> Rewritten:
    """Number words become digits, in runs of three or more or beside a written dot; a plus before them becomes its sign.

    What stands between the words of a run goes. One or two number words alone are words of a sentence.
    """
    found = [(m.start(), m.end(), w) for m in WORDS.finditer(s) if (w := m[0].lower()) in SPOKEN]
    runs: list[list[tuple[int, int, str]]] = []
    for x in found:
        gap = s[runs[-1][-1][1] : x[0]] if runs else None
        if gap is not None and 0 < len(gap) < 3 and not gap.strip(" \t\n-") and x[2] != "plus":
            runs[-1].append(x)
        elif x[2] != "oh":
            runs.append([x])
    edits: list[tuple[int, int, str]] = []
    for run in runs:
        signed = run[0][2] == "plus"
        if signed and len(run) == 1:
            if m := SPACED_DIGIT.match(s, run[0][1]):
                edits.append((run[0][0], m.end(), "+"))
            continue
        before, after = s[max(0, run[0][0] - 9) : run[0][0]].rstrip(), s[run[-1][1] : run[-1][1] + 9].lstrip()
        dotted = DOT_BEFORE.search(before) or DOT_BEHIND.match(after)
        if len(run) - signed >= 3 or dotted:
            for k, (a, b, word) in enumerate(run):
                if k:
                    edits.append((run[k - 1][1], a, ""))
                edits.append((a, b, "+" if word == "plus" else "0" if word == "oh" else DIGIT_OF[word]))
    return Rewritten(s, edits)


def _sign(s: str, a: int, b: int) -> tuple[int, int, str, bool] | None:
    """(start, end, @ or ., stands bare) of the written sign at a:b with what belongs to it."""
    word = s[a:b].lower()
    if word[0] == "&":
        m = ENTITY.fullmatch(word)
        return m and (a, b, "@" if m[1] else ".", False)
    left, right = s[max(0, a - 17) : a], s[b : b + 17]
    near, far = left.rstrip(), right.lstrip()
    new = "@" if word in AT else "."
    if near[-1:] and near[-1:] in "([{<" and far[:1] and far[:1] in ")]}>":
        return a - len(left) + len(near[:-1].rstrip()), b + len(right) - len(far[1:].lstrip()), new, False
    spaced = len(near) < len(left), len(far) < len(right)
    if all(spaced) and word in BARE or any(spaced) and word == "@":
        return a - len(left) + len(near), b + len(right) - len(far), new, word != "@"
    return None


def signs(s: str) -> Rewritten:
    """Written at and dot signs. A bare at needs a written dot behind it, or before it a name that no word of a sentence is."""
    found = [x for m in SIGNS.finditer(s) if (x := _sign(s, *m.span())) and x[0] > 0 and s[x[0] - 1] in LOCAL and LABEL.match(s, x[1])]
    dots = {a for a, _, new, _ in found if new == "."}
    edits: list[tuple[int, int, str]] = []
    for a, b, new, bare in found:
        if new == "@" and bare:
            end = (label := LABEL.match(s, b)).end()
            name = NAME.search(s, max(0, a - 64), a)[0]
            if label[0].lower() in ARTICLES or end not in dots and not (s[end : end + 1] == "." and LABEL.match(s, end + 1) and not name.isalpha() and name[-1].isalnum()):
                continue
        if not edits or a >= edits[-1][1]:
            edits.append((a, b, new))
    return Rewritten(s, edits)


def disguised(s: str) -> list[Span]:
    """(start, end, kind), in s, of the identifiers that only the normalised text shows."""
    steps, t = [], s
    for step in (characters, digits, signs):
        r = step(t)
        if r.starts:
            steps.append(r)
            t = r.text
    out = []
    for a, b, kind in plain(t) if steps else []:
        found = t[a:b]
        if kind == "email" and not re.fullmatch("[A-Za-z]{2,}", found.rpartition(".")[2]):
            continue  # a price behind an at sign
        for r in reversed(steps):
            a, b = r.source(a, b)
        if s[a:b] != found:
            out.append((a, b, kind))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(set(spans), key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row for each row of docs.

    The counts and the hash are of the plain identifiers; spans lists them and the n_added disguised ones beside them,
    as kind:start:end in characters. A disguised span may hold a plain one: both are listed. A null text counts as
    empty: counts of 0, the hash of nothing, no spans. Rows that repeat and null ids are rows of their own; an empty
    table gives an empty result; other columns are left out, whatever their names.
    """

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                s = value.as_py() or ""
                base = plain(s)
                more = set(disguised(s)) - set(base)
                counts = [sum(kind == x[2] for x in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed([*base, *more]), len(more)))
            kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds))], names)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text, plain or disguised, replaced by [KIND]; spans that overlap become one, of the first kind.

    A null text stays null; the other columns stay as they are.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([None if (s := x.as_py()) is None else without(s) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([clean if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema.set(at, batch.schema.field(at).with_type(pa.string())))

    return docs.mapInArrow(run, docs.schema)


def without(s: str) -> str:
    edits: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(plain(s) + disguised(s)):
        if edits and a < edits[-1][1]:
            edits[-1] = (edits[-1][0], max(b, edits[-1][1]), edits[-1][2])
        else:
            edits.append((a, b, f"[{kind.upper()}]"))
    return Rewritten(s, edits).text
