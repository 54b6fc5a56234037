"""WARC records and a Merkle fixity audit of replicas. DataFrame functions only.

Pages become WARC records, ordered by page id inside archives of 2**ARCHIVE_BITS ids, each with its byte offset. A
record's hash covers its offset, length and digest. The records that start in a range of 2**RANGE_BITS bytes of an
archive are hashed in the order of their offsets, 2**FAN_BITS neighbouring ranges again, and so on up to the archive;
archives are hashed in the same way up to one root. Two replicas are compared from their roots down, and only the
children of ranges that differ are read and compared at the next level, down to the records.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seshat.llm._io import discard, settle

FAN_BITS, RANGE_BITS, ARCHIVE_BITS = 4, 16, 12
#: Archives for the records of null ids, which are told apart by their digests.
NAMELESS = 4096
#: Rows sent to every task, at most.
MOST_SENT = 100_000


def record(page_id: F.Column, url: F.Column, body: F.Column) -> F.Column:
    """A page as the text of a WARC resource record; null url and body count as empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def file_no(page_id: F.Column, digest: F.Column) -> F.Column:
    """The number of the archive that a record lies in; the records of null ids are dealt over archives of their own."""
    nameless = F.conv(F.left(digest, F.lit(3)), 16, 10).cast("long") % NAMELESS - (1 << 62)
    return F.coalesce(F.shiftright(page_id, ARCHIVE_BITS), nameless)


def records(pages: DataFrame) -> DataFrame:
    """page_id, archive, record_offset, record_length, digest of each page.

    Records lie in the order of id and digest in their archive. Null ids have archive null: they lie in archives by
    the first letters of their digests. Repeated pages are records behind one another; the place of each follows from
    the first one's, so that an id repeated without end is one row of the window. Other columns are left out.
    """
    r = record(F.col("page_id"), F.col("url"), F.col("html"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), r.alias("r"))
    p = p.select("page_id", F.octet_length("r").cast("long").alias("record_length"), F.sha2("r", 256).alias("digest"))
    p = p.groupBy("page_id", "digest", "record_length").agg(F.count("*").alias("copies")).withColumn("file", file_no(F.col("page_id"), F.col("digest")))
    before = F.sum(F.col("record_length") * F.col("copies")).over(W.partitionBy("file").orderBy("page_id", "digest").rowsBetween(W.unboundedPreceding, -1))
    p = p.withColumn("first", F.coalesce(before, F.lit(0))).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    archive = F.shiftright("page_id", ARCHIVE_BITS).alias("archive")
    return p.select("page_id", archive, (F.col("first") + F.col("nth") * F.col("record_length")).cast("long").alias("record_offset"), "record_length", "digest")


def _steps(*replicas: DataFrame) -> list[tuple[int, int] | None]:
    """How many bits of archive and place each level drops to come to the next one, the same for all replicas.

    None stands for the last step, to the root.
    """
    place, archive = F.max("record_offset"), F.shiftright("page_id", ARCHIVE_BITS)
    ends = [t.agg(place, F.min(archive), F.max(archive)).first() for t in replicas]
    steps: list[tuple[int, int] | None] = [(0, RANGE_BITS)]
    left = max((r[0] or 0 for r in ends), default=0) >> RANGE_BITS
    while left:
        steps.append((0, FAN_BITS))
        left >>= FAN_BITS
    low, high = (pick((r[k] for r in ends if r[k] is not None), default=0) for k, pick in ((1, min), (2, max)))
    while high - low > 1:
        steps.append((FAN_BITS, 0))
        low, high = low >> FAN_BITS, high >> FAN_BITS
    return [*steps, None]


def _up(step: tuple[int, int] | None) -> list[F.Column]:
    """file and node of the next level."""
    if step is None:
        return [F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("node")]
    return [F.shiftright("file", step[0]).alias("file"), F.shiftright("node", step[1]).alias("node")]


def tree(found: DataFrame, steps: list[tuple[int, int] | None]) -> list[DataFrame]:
    """The levels of a replica's tree, from records to the root: file, node, hash.

    Level 0 holds the records by archive and offset; those that claim one offset are hashed together.
    """
    keyed = found.groupBy(file_no(F.col("page_id"), F.col("digest")).alias("file"), F.col("record_offset").alias("node"), "record_length", "digest").agg(F.count("*").alias("copies"))
    one = F.concat_ws(":", "node", "record_length", "digest", "copies")
    levels = [settle(keyed.groupBy("file", "node").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "|"), 256).alias("hash")))]
    for step in steps:
        file, node = _up(step)
        parts = F.array_sort(F.collect_list(F.struct(F.col("file").alias("f"), F.col("node").alias("n"), "hash")))
        joined = F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["f"], x["n"], x["hash"])), "|")
        levels.append(settle(levels[-1].groupBy(file, node).agg(F.sha2(joined, 256).alias("hash"))))
    return levels


def differing(a: list[DataFrame], b: list[DataFrame], steps: list[tuple[int, int] | None]) -> DataFrame:
    """file, node: the offsets at level 0 where the trees differ, found from the roots down."""
    suspects: DataFrame | None = None
    for k in range(len(steps), -1, -1):
        x, y = a[k], b[k]
        if suspects is not None:
            above = suspects.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
            above = F.broadcast(above) if above.count() <= MOST_SENT else above
            file, node = _up(steps[k])
            x, y = (t.withColumns({"up_file": file, "up_node": node}).join(above, ["up_file", "up_node"], "left_semi").select("file", "node", "hash") for t in (x, y))
        both = x.withColumnRenamed("hash", "h").join(y, ["file", "node"], "full")
        suspects = settle(both.where(~F.col("h").eqNullSafe(F.col("hash"))).select("file", "node"))
    return suspects


def audit(master: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, archive, record_offset, record_length, digest, replica_digest, replica_offset, status of damaged records.

    master and replica: records(), or what an index of the replica says of its records. status is changed (another
    digest under the id), moved (the same digest at another offset), missing (from the replica) or extra (only there).
    archive, offset and length are the master's, or the replica's where there is no other. Records that repeat an id
    are paired in the order of their offsets. Records of null ids are told apart by their digests: a changed one is
    missing and extra. Equal replicas, and two empty ones, give no rows. Other columns are left out.
    """
    own = ["page_id", "archive", "record_offset", "record_length", "digest"]
    master, replica = settle(master.select(*own)), settle(replica.select(*own))
    steps = _steps(master, replica)
    a, b = tree(master, steps), tree(replica, steps)
    bad = differing(a, b, steps)
    discard(*a, *b)
    bad = F.broadcast(bad) if bad.count() <= MOST_SENT else bad
    file = file_no(F.col("page_id"), F.col("digest"))
    m, r = (settle(t.withColumns({"file": file, "node": F.col("record_offset")}).join(bad, ["file", "node"], "left_semi").select(*own)) for t in (master, replica))
    key = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("digest "), F.col("digest")))
    # what stands in both at its offset is whole, however many records claim the offset
    nth = W.partitionBy("key", "digest", "record_offset").orderBy("record_length")
    m, r = (t.withColumn("key", key).withColumn("nth", F.row_number().over(nth)) for t in (m, r))
    same = ["key", "digest", "record_offset", "record_length", "nth"]
    m, r = m.join(r.select(*same), same, "left_anti"), r.join(m.select(*same), same, "left_anti")
    out = []
    for by, status in ((["key", "digest"], "moved"), (["key"], "changed")):
        order = W.partitionBy(*by).orderBy("record_offset", "digest")
        m, r = (settle(t.select("key", *own).withColumn("nth", F.row_number().over(order))) for t in (m, r))
        pairs = m.select(*by, "nth", F.struct(*own).alias("m")).join(r.select(*by, "nth", F.struct(*own).alias("r")), [*by, "nth"])
        out.append(pairs.select("m", "r", F.lit(status).alias("status")))
        m, r = (x.join(y.select(*by, "nth"), [*by, "nth"], "left_anti") for x, y in ((m, r), (r, m)))
    none = F.lit(None).cast(out[0].schema["m"].dataType)
    out.append(m.select(F.struct(*own).alias("m"), none.alias("r"), F.lit("missing").alias("status")))
    out.append(r.select(none.alias("m"), F.struct(*own).alias("r"), F.lit("extra").alias("status")))
    place = F.coalesce("m", "r")
    every = reduce(DataFrame.union, out)
    return every.select(*(place[c].alias(c) for c in own[:4]), F.col("m.digest").alias("digest"), F.col("r.digest").alias("replica_digest"), F.col("r.record_offset").alias("replica_offset"), "status")


def damaged(pages: DataFrame, ids: Sequence[int] = (3, 11), every: int = 50) -> DataFrame:
    """The records of a replica to rehearse the audit on, which lie where the master's do.

    Of each `every` page ids, the first of `ids` has every t and T of its body written as 7, which keeps its length;
    the record of the second cannot be read. Null ids are left alone.
    """
    change, lose = ids
    at = F.coalesce(F.pmod(F.col("page_id"), F.lit(every)), F.lit(-1))
    body = F.when(at == change, F.regexp_replace("html", "[tT]", "7")).otherwise(F.col("html"))
    return records(pages.withColumn("html", body)).where(at != lose)
