import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from seshat.llm import mixing, warc_fixity
from seshat.llm._io import settle
from seshat.llm.minhash_dedup import deduplicated


def expected_targets(sizes):
    """Water filling by repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mixture(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"s{min(9, int(rng.exponential(2)))}" if i % 17 else None, "w " * int(rng.integers(0, 400)), 1) for i in range(900)]
    rows += [(900, "tiny", "a b", 1), (901, "zero", None, 1), (None, "s0", "a b c", 1), (5, "s0", "a b c", 1), (5, "s0", "a b c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, taken int")
    m = mixing.mixture(mixing.sizes(docs), block_words=500)
    got = m.collect()
    assert len(got) == len(rows)
    source, taken, size = {}, defaultdict(int), defaultdict(int)
    for r in got:
        assert r.taken == sum(d.words for d in r.draws) and 0 <= r.taken <= 3 * r.size
        source[r.source] = (r.source_size, r.target)
        taken[r.source] += r.taken
        size[r.source] += r.size
    want = expected_targets(dict(size))
    for s, (n, target) in source.items():
        assert n == size[s] and abs(target - want[s]) < 1e-6 and abs(taken[s] - target) <= 1
    again = {(r.doc_id, r.size): r.taken for r in m.orderBy(F.rand()).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in got}
    # each block is in one place of one shard for each pass
    places = mixing.drawn_rows(m).select("source", "pass", "shard", "place").distinct()
    assert places.groupBy("shard", "place").count().where("count > 1").count() == 0
    assert mixing.mixture(mixing.sizes(docs.limit(0))).count() == 0


def test_splitting_tree_keeps_exact_counts():
    counts = np.array([100, 0, 37, 5, 1])

    def dealt(seed, step=1):
        out = np.zeros((7, 5), np.int64)
        for shard, at, n in mixing.split_counts(np.arange(5), counts, 0, 7, seed, step):
            out[shard, at] = n
        return out

    got = dealt(3)
    assert (got.sum(0) == counts).all() and (got >= 0).all()
    assert got.sum(1).max() - got.sum(1).min() <= 2
    many = np.mean([dealt(s)[:, 0] for s in range(200)], 0)
    assert np.allclose(many, 100 / 7, atol=1)
    # the walk may stop above the leaves
    assert (dealt(3, 2).sum(0) == counts).all() and set(np.flatnonzero(dealt(3, 2).sum(1))) == {0, 2, 4, 6}


def test_draws_come_from_the_tree(spark, monkeypatch):
    """Each shard takes of each source what its leaf says, and the draws change with the tree."""
    rows = [(i, f"s{i % 3 * (i % 5 > 0)}", 40 + i % 7) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    monkeypatch.setattr(mixing, "BUCKET", 8)  # runs and draws cross the borders of buckets
    seen = []
    leaves = mixing.leaves
    monkeypatch.setattr(mixing, "leaves", lambda *a: seen.append(leaves(*a)) or seen[-1])
    mixed = mixing.mixture(docs, block_words=300, shard_blocks=8, least_blocks=8)
    drawn = mixing.drawn_rows(mixed).collect()
    number = {s: k + 1 for k, s in enumerate(sorted({r[1] for r in rows}))}
    want = {(r.source_no, r.shard): r.n for r in seen[0].collect()}
    places = defaultdict(set)
    for r in drawn:
        places[number[r.source], r.shard].add(r.place)
    assert {k: len(v) for k, v in places.items()} == want and len({s for _, s in want}) > 3

    def even(quotas, shards, seed):
        return quotas.select("source_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "n").withColumn("n", F.floor((F.col("shard") + 1) * F.col("n") / shards) - F.floor(F.col("shard") * F.col("n") / shards)).where("n > 0")

    monkeypatch.setattr(mixing, "leaves", even)
    other = {r.doc_id: r.draws for r in mixing.mixture(docs, block_words=300, shard_blocks=8, least_blocks=8).collect()}
    assert other != {r.doc_id: r.draws for r in mixed.collect()}


def test_mixture_keeps_other_columns(spark):
    rows = [(1, "a", "x y z", 1, 2, 3, "q"), (1, "a", "x y z", 1, 2, 3, "q"), (None, "a", None, None, 2, 3, None), (2, None, "w " * 30_000, 4, 5, 6, "r"), (3, "b", "", 7, 8, 9, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, s int, b int, drawn int, block string")
    m = mixing.mixture(mixing.sizes(docs))
    got = m.collect()
    assert m.columns == ["doc_id", "source", "size", "source_size", "target", "taken", "draws", "s", "b", "drawn", "block"]
    assert sorted((r.s, r.b, r.drawn, r.block) for r in got if r.s) == [(1, 2, 3, "q"), (1, 2, 3, "q"), (4, 5, 6, "r"), (7, 8, 9, "t")]
    assert {r.doc_id: r.size for r in got} == {1: 3, None: 0, 2: 30_000, 3: 0}
    assert all(r.taken <= 3 * r.size for r in got)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_audit_finds_what_differs(spark):
    rows = [(i * 37, f"http://h/{i}", f"<p>{'t' * i}</p>") for i in range(300)] + [(None, None, None), (None, "n", "x"), (5, "u", "same"), (5, "u", "same"), (5, "u", "other"), (-7, "below", "zero")]
    a = warc_fixity.records(pages(spark, rows)).withColumn("file", F.lit("x"))
    assert warc_fixity.audit(a, a).count() == 0
    # records that cannot be read, another body of the same length and a record nobody knows: the others lie where they did
    other = F.when(F.col("page_id").isin(370, 740), F.sha2("digest", 256)).otherwise(F.col("digest"))
    new = spark.createDataFrame([(9_999_999, 2441, 0, 77, "d" * 64)], "page_id long, archive long, record_offset long, record_length long, digest string")
    b = a.drop("file").where("page_id <> 1110 or page_id is null").withColumn("digest", other).union(new)
    got = {(r.page_id, r.status) for r in warc_fixity.audit(a, b).collect()}
    assert got == {(370, "changed"), (740, "changed"), (1110, "missing"), (9_999_999, "extra")}
    empty = warc_fixity.records(pages(spark, []))
    assert warc_fixity.audit(empty, empty).count() == 0
    assert {r.status for r in warc_fixity.audit(a, empty).collect()} == {"missing"}
    assert warc_fixity.audit(empty, a).where("status = 'extra'").count() == len(rows)


def test_audit_sees_offsets(spark):
    """A replica whose records have moved is not whole, though every record is."""
    a = warc_fixity.records(pages(spark, [(i, "u", "t" * i) for i in range(40)]))
    got = warc_fixity.audit(a, a.withColumn("record_offset", F.col("record_offset") + 1000)).collect()
    assert len(got) == 40 and all(r.status == "moved" and r.replica_offset == r.record_offset + 1000 and r.digest == r.replica_digest for r in got)
    # written anew without one record, those behind it in its archive have moved
    b = warc_fixity.records(pages(spark, [(i, "u", "t" * i) for i in range(40) if i != 30]))
    assert sorted((r.page_id, r.status) for r in warc_fixity.audit(a, b).collect()) == [(30, "missing")] + [(i, "moved") for i in range(31, 40)]


def test_audit_reads_only_what_differs(spark, monkeypatch):
    a = warc_fixity.records(pages(spark, [(i, "u", "t" * (i % 50)) for i in range(3000)]))
    b = a.withColumn("digest", F.when(F.col("page_id") == 1234, F.lit("0" * 64)).otherwise(F.col("digest")))
    steps = warc_fixity._steps(a, b)
    x, y = warc_fixity.tree(a, steps), warc_fixity.tree(b, steps)
    differ = [p.exceptAll(q).count() for p, q in zip(x, y)]
    assert differ == [1] * len(x) and len(x) >= 4 and x[-1].count() == 1


def test_records_lie_at_their_offsets(spark):
    p = pages(spark, [(i, f"u{i}", "é" * i) for i in range(20)])
    text = {r.page_id: r.t for r in p.select("page_id", warc_fixity.record(F.col("page_id"), F.col("url"), F.col("html")).alias("t")).collect()}
    whole = b"".join(text[i].encode() for i in range(20))
    for r in warc_fixity.records(p).collect():
        part = whole[r.record_offset : r.record_offset + r.record_length]
        assert part.decode() == text[r.page_id] and hashlib.sha256(part).hexdigest() == r.digest


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in "ba co di fu ge ho".split() for b in "lan mor tis ven pol rud".split()]
    text = lambda n: " ".join(rng.choice(words, n))
    rows, labels, item = [], [], text(30)
    for i in range(300):
        t = text(80)
        if i % 6 == 0:
            t += " grobnak sludgy vilenork grobnak"
        rows.append((i, t))
        labels.append((i, 0, int(i % 6 == 0)))
    rows += [(400, rows[1][1]), (401, rows[1][1] + " end"), (402, text(40) + " " + item + " " + text(9)), (403, text(30) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + text(9))]
    rows += [(404, None), (405, ""), (None, text(50))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or "")) for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        d = settle(stage(spark, d, str(tmp_path)))
        seen[name] = d
        if name != "mixing":
            assert d.columns == docs.columns
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    clean = {i for i in range(300) if i % 6}
    assert ids("toxicity") == clean | {400, 401, 402, 403, 404, 405, None}
    assert ids("near_dedup") == clean | {402, 403, 404, 405, None}
    assert ids("decontamination") == clean | {403, 404, 405, None}
    masked = seen["secrets"].where("doc_id = 403").first()
    assert 'token = "[SECRET]"' in masked.text and masked.n_chars == len(masked.text)
    assert ids("secrets") == ids("mixing") == clean | {403, 404, 405, None}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["mixing"].count()


def test_deduplication_tells_rows_apart(spark):
    """Only near-duplicates go, however ids repeat; columns of any name stay."""
    t, u, v = ("alpha beta gamma delta " * 1, "wholly different words stand here now", "yet another text of some words")
    rows = [(3, t, 1), (7, t, 2), (7, u, 3), (7, u, 3), (7, u, 4), (9, v, 5), (None, v, 6), (None, "lone text without an id at all", 7), (None, "lone text without an id at all", 8), (1, None, 9), (1, "", 10), (2, " ", 11), (2, " ", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seshat_key int")
    got = sorted((tuple(r) for r in deduplicated(docs).collect()), key=str)
    want = [(3, t, 1), (7, u, 3), (9, v, 5), (None, rows[7][1], 7), (1, None, 9), (1, "", 10), (2, " ", 11)]
    assert got == sorted(want, key=str)
    assert deduplicated(docs.limit(0)).count() == 0 and deduplicated(docs).columns == docs.columns


def test_pipeline_of_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, seshat_key string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
