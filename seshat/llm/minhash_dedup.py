"""MinHash near-duplicate detection by a signature-coordinate inverted join.

1. One pass over the texts gives each document its class (the hash of its whole shingle set: exact copies and equal
   sets fall together) and a signature of COORDINATES minima.
2. Classes are posted under (coordinate, value). Two signatures that agree in at least MATCHES coordinates agree in
   one of the first COORDINATES - MATCHES + 1 under any common order, so only that prefix is posted; the order puts
   rare pairs first, by a table of counts of fixed size (COORDINATES * 2**COUNT_BITS counters).
3. Within a posting the rest of the signature is counted against a leader, then what the leader leaves against the
   next one, so that a posting of n classes yields fewer than n links and never its n * n pairs. Postings above
   `posting_rows` classes are dealt over salts; the leaders of the salts meet again in a second posting.
4. The links join classes into families, a coarser grouping than the result. Each family's full shingle sets are
   compared exactly, in blocks of bounded size; families of several blocks meet block by block.
5. Confirmed links give the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seshat.llm._io import discard, groups, settle, spare
from seshat.llm._words import U, buffers, mix, shingles, word_hashes
from seshat.llm.components import components, roots

COORDINATES, MATCHES, COUNT_BITS = 64, 36, 12
PREFIX = COORDINATES - MATCHES + 1


def _signer() -> Callable[[np.ndarray], np.ndarray]:
    rng = np.random.default_rng(8)
    a = rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | U(1)
    b = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)

    def sign(x: np.ndarray) -> np.ndarray:
        low = np.full(COORDINATES, np.iinfo(U).max, U)
        for i in range(0, len(x), 1024):
            np.minimum(low, (x[i : i + 1024, None] * a + b).min(0), out=low)
        return (low >> U(32)).astype(np.uint32)

    return sign


def class_of(x: np.ndarray) -> int:
    """A 63-bit name of a set of shingle hashes."""
    return int((mix(x * U(0xA24BAED4963EE407) + U(len(x))).sum(dtype=U) ^ U(len(x) * 0x9E3779B9)) >> U(1))


def _row(i: Column, key: Column) -> Column:
    """A hash of a row's id and of the hash of its text."""
    return F.xxhash64(F.coalesce(i, F.lit(0).cast("long")), i.isNull(), key)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, key, n, cls, sig) of each row: key is a hash of the text; cls and sig are null where a text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _signer()
        for batch in batches:
            n, cls, sig = [], [], []
            for _, words in word_hashes(*buffers(batch.column(2))):
                x = shingles(words, size)
                n.append(len(x))
                cls.append(class_of(x) if len(x) else None)
                sig.append(sign(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary())], ["id", "key", "n", "cls", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, key long, n long, cls long, sig binary")


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), COORDINATES)


def _slots(m: np.ndarray) -> np.ndarray:
    """The counter of each signature value."""
    return (m & np.uint32((1 << COUNT_BITS) - 1)).astype(np.int64) + (np.arange(COORDINATES) << COUNT_BITS)


def value_counts(classes: DataFrame) -> np.ndarray:
    """How often each counter's values occur; a table of fixed size whatever the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(COORDINATES << COUNT_BITS, np.int64)
        for x in batches:
            if len(x):
                count += np.bincount(_slots(_matrix(x.sig)).ravel(), minlength=len(count))
        at = np.flatnonzero(count)
        yield pd.DataFrame({"slot": at, "n": count[at]})

    got = classes.select("sig").mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COORDINATES << COUNT_BITS, np.int64)
    out[got.slot] = got.n
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column."""
    rows = np.ascontiguousarray(rows)
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of equally long byte strings as a matrix."""
    data = np.frombuffer(column.cast(pa.binary()).buffers()[2], np.uint8) if len(column) else np.empty(0, np.uint8)
    return data[column.offset * width : (column.offset + len(column)) * width].reshape(-1, width)


def postings(classes: DataFrame, counts: np.ndarray, posting_rows: int) -> DataFrame:
    """(key, salt, cls, sig): each class under the PREFIX rarest of its (coordinate, value) pairs; sig keeps four bits a coordinate."""
    held = classes.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held.value
        for whole in batches:
            for i in range(0, len(whole), 2000):
                x = whole.slice(i, 2000)
                m = _rows(x.column(1), 4 * COORDINATES).copy().view(np.uint32)
                slot = _slots(m)
                n = count[slot]
                at = np.argsort(n * COORDINATES + np.arange(COORDINATES), axis=1, kind="stable")[:, :PREFIX].ravel()
                row = np.repeat(np.arange(len(x)), PREFIX)
                key = mix(m[row, at].astype(U) << U(8) | at.astype(U)).view(np.int64)
                cls = x.column(0).to_numpy()[row]
                salts = n[row, at] // posting_rows + 1
                salt = np.where(salts > 1, (mix(cls.view(U) + U(77)) % salts.astype(U)).astype(np.int64) + 1, 0)
                short = ((m ^ m >> np.uint32(16)) & np.uint32(15)).astype(np.uint8)
                packed = short[:, ::2] | short[:, 1::2] << 4
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt), pa.array(cls), _binary(packed[row])], ["key", "salt", "cls", "sig"])

    return classes.select("cls", "sig").mapInArrow(run, "key long, salt long, cls long, sig binary")


def _links(post: DataFrame) -> DataFrame:
    """(kind, key, a, b, sig): kind 0 links a to the leader b; kind 1 hands leader a of a salt on to the next posting."""
    chunk = 16_384
    names, schema = ["kind", "key", "a", "b", "sig"], "kind int, key long, a long, b long, sig binary"

    def linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        zero = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32)), pa.array(zero), pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], names)

    def posting(key: int, salt: int, cls: np.ndarray, sigs: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(mix(cls.view(U) ^ U(key & (2**64 - 1))))  # every posting has leaders of its own
        cls, sigs = cls[order], sigs[order]
        led: list[int] = []
        for i in range(0, len(cls), chunk):
            left = np.arange(i, min(i + chunk, len(cls)))
            for lead in led:
                if len(left):
                    left, found = _absorb(sigs, lead, left)
                    if len(found):
                        yield linked(cls[found], np.full(len(found), cls[lead]))
            while len(left):
                led.append(lead := int(left[0]))
                left, found = _absorb(sigs, lead, left[1:])
                if len(found):
                    yield linked(cls[found], np.full(len(found), cls[lead]))
        if salt:
            n = len(led)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(np.full(n, key)), pa.array(cls[led]), pa.nulls(n, pa.int64()), _binary(sigs[led])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # a posting goes on into the next batch
        for batch in batches:
            if not len(batch):
                continue
            key, salt, cls = (batch.column(c).to_numpy() for c in range(3))
            sigs = _rows(batch.column(3), COORDINATES // 2)
            cut = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1, [len(key)]])
            if held and (held[0][0], held[0][1]) != (key[0], salt[0]):
                yield from posting(held[0][0], held[0][1], *(np.concatenate(x) for x in zip(*(h[2:] for h in held))))
                held = []
            first, last = int(bool(held) and len(cut) > 2), len(cut) - 2
            if first:
                held.append((int(key[0]), int(salt[0]), cls[: cut[1]].copy(), sigs[: cut[1]].copy()))
                yield from posting(held[0][0], held[0][1], *(np.concatenate(x) for x in zip(*(h[2:] for h in held))))
                held = []
            size = np.diff(cut)[first:last]
            at = cut[first:last]
            two = at[(size == 2) & (salt[at] == 0)]
            like = two[_agree(sigs[two], sigs[two + 1]) >= MATCHES]
            if len(like):
                yield linked(cls[like], cls[like + 1])
            for i, n in zip(at, size):
                if n > 2 or salt[i]:
                    yield from posting(int(key[i]), int(salt[i]), cls[i : i + n], sigs[i : i + n])
            i = cut[last]
            held.append((int(key[i]), int(salt[i]), cls[i:].copy(), sigs[i:].copy()))
        if held:
            yield from posting(held[0][0], held[0][1], *(np.concatenate(x) for x in zip(*(h[2:] for h in held))))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for x in run(batches):
            out.append(x)
            n += len(x)
            if n >= 20_000:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out, n = [], 0
        if n:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return post.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(gathered, schema)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates packed signatures agree; by chance in a sixteenth of the others, which only adds."""
    x = a ^ b
    return ((x & 15) == 0).sum(1) + (x < 16).sum(1)


def _absorb(sigs: np.ndarray, lead: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What of `left` the leader does not hold, and what it does."""
    if not len(left):
        return left, left
    like = _agree(sigs[left], sigs[lead]) >= MATCHES
    return left[~like], left[like]


def families(classes: DataFrame, posting_rows: int) -> DataFrame:
    """(v, p): classes that may be linked, directly or by way of others, with the smallest of their family."""
    found = settle(_links(postings(classes, value_counts(classes), posting_rows)))
    edges = found.where("kind = 0").select("a", "b")
    again = found.where("kind = 1").select("key", F.lit(0).cast("long").alias("salt"), F.col("a").alias("cls"), "sig")
    if again.limit(1).count():
        edges = edges.union(_links(again).where("kind = 0").select("a", "b"))
    out = components(edges)
    discard(found)
    return out


def exact_links(sets: list[np.ndarray], percent: int, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sets meet 100 * intersection >= percent * union. With `left`, only pairs across that boundary."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = 100 * both >= percent * (size.sum() - both)
        return (np.array([0]), np.array([1])) if hit else (np.empty(0, int), np.empty(0, int))
    value, count = np.unique(np.concatenate(sets), return_counts=True)
    value = value[count > 1]
    rows = slice(0, n if left is None else left)
    cols = slice(0 if left is None else left, n)
    shared = np.zeros((rows.stop - rows.start, cols.stop - cols.start), np.float32)
    wide = max(256, (1 << 22) // max(n, 1))
    spans = [np.searchsorted(value, s) for s in sets]
    kept = [(at := sp[sp < len(value)])[value[at] == s[: len(at)]] if len(value) else sp[:0] for sp, s in zip(spans, sets)]
    for i in range(0, len(value), wide):
        grid = np.zeros((n, min(wide, len(value) - i)), np.float32)
        for r, k in enumerate(kept):
            grid[r, k[np.searchsorted(k, i) : np.searchsorted(k, i + wide)] - i] = 1
        shared += grid[rows] @ grid[cols].T
    shared = shared.astype(np.int64)
    hit = 100 * shared >= percent * (size[rows, None] + size[None, cols] - shared)
    if left is None:
        hit = np.triu(hit, 1)
    a, b = np.nonzero(hit)
    return a, b + (0 if left is None else left)


def confirmed(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, classes: DataFrame, family: DataFrame, block_docs: int, block_shingles: int, broadcast_rows: int) -> tuple[DataFrame, bool]:
    """Links (a, b) of classes confirmed on their full sets; whether some family took more than one block."""
    member = family.select(F.col("v").alias("cls"), "p").union(family.select(F.col("p").alias("cls"), "p").distinct())
    member = member.join(classes.select("cls", "row", "n"), "cls")
    bulk = member.groupBy("p").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    bulk = bulk.select("p", F.greatest(F.ceil(F.col("docs") / block_docs), F.ceil(F.col("shingles") / block_shingles)).cast("int").alias("blocks"))
    member = settle(member.join(bulk, "p").select("cls", "p", "row", "blocks"))
    several = bool(member.where("blocks > 1").limit(1).count())
    keys, place = member.select("row").distinct(), member.drop("row")
    if member.count() <= broadcast_rows:
        keys, place = F.broadcast(keys), F.broadcast(place)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows equal in id and text are one
        for batch in batches:
            cls, x = [], []
            for _, words in word_hashes(*buffers(batch.column(0))):
                s = shingles(words, size)
                c = class_of(s)
                if c not in seen:
                    seen.add(c)
                    cls.append(c)
                    x.append(s.tobytes())
            for i in range(0, len(cls), 256):
                yield pa.RecordBatch.from_arrays([pa.array(cls[i : i + 256], pa.int64()), pa.array(x[i : i + 256], pa.binary())], ["cls", "x"])

    texts = docs.select(_row(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("row"), F.col(text_col).alias("text")).join(keys, "row", "left_semi").select("text")
    found = texts.mapInArrow(sets, "cls long, x binary").join(place, "cls")
    b = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("cls"), "blocks")).otherwise(0).cast("int")
    found = found.select("cls", "x", "p", "blocks", b.alias("own"))
    # each member goes to the pairs of blocks that hold its own; one block is a pair by itself
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    found = found.select("cls", "x", "p", "own", F.explode(pairs).alias("at")).select("cls", "x", "own", F.xxhash64("p", "at.i", "at.j").alias("group"), F.col("at.i").alias("i"), F.col("at.j").alias("j"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_out, b_out = [], []
        for g in groups(batches, "group"):
            g = g.drop_duplicates("cls").sort_values("own", kind="stable")
            if len(g) < 2:
                continue
            cls = g.cls.to_numpy()
            across = g.i.iloc[0] != g.j.iloc[0]
            left = int((g.own == g.i.iloc[0]).sum()) if across else None
            if across and left in (0, len(g)):
                continue
            a, b = exact_links([np.frombuffer(x, U) for x in g.x], percent, left)
            if len(a):
                v, p = roots(cls[a], cls[b])
                a_out.append(v[v != p])
                b_out.append(p[v != p])
        if a_out:
            yield pd.DataFrame({"a": np.concatenate(a_out), "b": np.concatenate(b_out)})

    return found.repartition("group").sortWithinPartitions("group").mapInPandas(compare, "a long, b long"), several


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, posting_rows: int = 50_000, block_docs: int = 1500, block_shingles: int = 4_000_000, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key, group_id for each row of docs.

    Words are runs of bytes other than space and \\t-\\r, A-Z as a-z; a document's set holds its distinct runs of
    `shingle` words, or all its words as one run if it has fewer. Documents whose sets meet
    100 * intersection >= percent * union are linked; component_id is the smallest id reachable, kept tells whether
    that is the row's own. text_key is the xxhash64 of the text; group_id names the component by its texts, so that
    rows are told apart where ids are null or repeated (null: no words).

    Null, empty and blank texts have no set and link with nothing. A null id gives component_id null, kept true and
    names no component; its text still joins what it links. Rows that repeat an id are each a row of the result;
    texts that differ under one id are separate members. Ties do not arise. Other columns are left out. An empty
    table gives an empty result. Ids of families are sent to every task if there are at most `broadcast_rows`,
    else the texts are shuffled to them.
    """
    rows = settle(signatures(docs, id_col, text_col, shingle))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "key")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("rows"))
    classes = settle(classes.select("cls", F.col("rep.id").alias("rep"), _row(F.col("rep.id"), F.col("rep.key")).alias("row"), "n", "sig", "rows"))
    family = families(classes, posting_rows)
    links, several = confirmed(docs, id_col, text_col, shingle, percent, classes, family, block_docs, block_shingles, broadcast_rows)
    links = settle(links)
    star = components(links) if several else links.select(F.col("a").alias("v"), F.col("b").alias("p"))
    member = star.union(star.select(F.col("p").alias("v"), "p").distinct()).join(classes.select(F.col("cls").alias("v"), "rep"), "v")
    low = member.groupBy("p").agg(F.min("rep").alias("low"))
    low = member.join(low, "p").select(F.col("v").alias("cls"), F.col("p").alias("root"), "low")
    known = classes.select("cls", "rep", "rows").join(low, "cls", "left")
    known = settle(known.select("cls", F.coalesce("low", "rep").alias("low"), F.coalesce("root", "cls").alias("root"), "rows"))
    # a class with over a thousandth of the rows does not go through one task: there are fewer than a thousand of them
    hot = F.broadcast(known.where(F.col("rows") * 1000 > rows.count()).select("cls", "low", "root"))
    own, known = rows.select("id", "key", "n", "cls"), known.select("cls", "low", "root")
    rest = own.where("cls is not null").join(hot, "cls", "left_anti").join(known, "cls", "left")
    none = F.lit(None).cast("long")
    out = rest.unionByName(own.join(hot, "cls")).unionByName(own.where("cls is null").withColumns({"low": none, "root": none}))
    component = F.when(F.col("id").isNotNull(), F.coalesce("low", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.col("key").alias("text_key"), F.col("root").alias("group_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with their columns, of which one stays of each group of near-duplicates.

    It is the row with the smallest id (null last), of those the one with the smallest hash of its text, and of rows
    equal in both the smallest by its columns in order. Rows are told apart by id and text: another text under the
    same id stays. Texts without words are near-duplicates of nothing; repeats of one id and text stay once. options
    are those of near_duplicates.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    each = found.groupBy("group_id", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    each = settle(each)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "rows")).alias("first")
    kept = each.where("group_id is not null").groupBy("group_id").agg(first).select("first.doc_id", "first.text_key", "first.rows")
    kept = kept.unionByName(each.where("group_id is null").select("doc_id", "text_key", "rows"))
    key = spare("seshat_key", docs.columns)
    kept = settle(kept.select(_row(F.col("doc_id"), F.col("text_key")).alias(key), (F.col("rows") > 1).alias("twice")))
    keyed = docs.withColumn(key, _row(F.col(id_col).cast("long"), F.xxhash64(text_col)))
    once = keyed.join(kept.where("not twice").select(key), key, "left_semi").select(*docs.columns)
    twice = kept.where("twice").select(key)
    if not twice.limit(1).count():
        return once
    held = keyed.join(twice, key, "left_semi").select(key, F.struct(*docs.columns).alias("row"))
    return once.union(held.groupBy(key).agg(F.min("row").alias("row")).select("row.*"))
