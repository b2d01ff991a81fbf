"""The pipeline's stages on odd rows, each against brute force on its own input."""

import hashlib
import heapq
import math
import os
import random
import re
from decimal import Decimal
from fractions import Fraction

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, odd, texts_of  # noqa: F401

from tokenledger.llm import mixing


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=repr)


def test_stages(spark, odd, tmp_path):  # noqa: F811
    pytest.importorskip("public_tokenizers")
    docs = odd.select(*corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.language(spark, docs, "")
    assert sorted(r.doc_id for r in docs.collect() if r.doc_id not in {x.doc_id for x in kept.collect()} and r.doc_id is not None) == [1, 2, 3, 7]
    assert kept.columns == docs.columns
    kept.write.parquet(str(tmp_path / "1"))
    before = spark.read.parquet(str(tmp_path / "1"))
    unique = corpus_pipeline.exact_dedup(spark, before, "")
    norm = {}
    for d, t in texts_of(before):
        k = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        norm[k] = min((x for x in (norm.get(k), d) if x is not None), default=None)
    assert sorted(map(repr, (r.doc_id for r in unique.collect()))) == sorted(map(repr, norm.values()))
    unique.write.parquet(str(tmp_path / "2"))
    before = spark.read.parquet(str(tmp_path / "2"))
    near = corpus_pipeline.near_dedup(spark, before, "")
    comp, _ = brute_components(texts_of(before), 5, 80)
    assert {r.doc_id for r in near.collect() if r.doc_id is not None} == {d for d, c in comp.items() if d == c}
    near.write.parquet(str(tmp_path / "3"))
    before = spark.read.parquet(str(tmp_path / "3"))
    mixed = corpus_pipeline.mixture(spark, before, "")
    times = {r.doc_id: max(1, round(r.taken / r.size)) if r.taken else 0 for r in mixing.mix(before).collect() if r.doc_id is not None}
    got = [r.doc_id for r in mixed.collect()]
    assert {d: got.count(d) for d in times} == times
    out = corpus_pipeline.encode(spark, mixed, "")
    assert out.count() == mixed.count()


def test_empty(spark, odd):  # noqa: F811
    docs = odd.select(*corpus_pipeline.COLUMNS).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_rows_without_an_id_stay(spark, tmp_path):
    """Null ids with texts of their own, some of one size, pass every stage; a copy of a text that has an id goes."""
    texts = ["the cat and the dog are in the house", "it was for the best that we are on time", "at the end of the day it is that"]
    rows = [(None, t, "en", s, len(t)) for t, s in zip(texts, ("a", "a", None), strict=True)] + [(1, "this is one with an id of its own", "en", "a", 1), (None, "this is one  with an id of its own", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "0"))
    before = spark.read.parquet(str(tmp_path / "0"))
    # every row has letters and none is held back, so language keeps all, the null ids' rows too
    kept = corpus_pipeline.language(spark, before, "")
    assert sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=repr) == sorted(((r[0], r[1], r[3]) for r in rows), key=repr)
    want = sorted([(None, t) for t in texts] + [(1, rows[3][1])], key=repr)
    for name in ("exact_dedup", "near_dedup"):
        before = dict(corpus_pipeline.STAGES)[name](spark, before, "")
        assert sorted(((r.doc_id, r.text) for r in before.collect()), key=repr) == want
    before.write.parquet(str(tmp_path / "1"))
    before = spark.read.parquet(str(tmp_path / "1"))
    times = {(r.doc_id, r.digest): max(1, round(r.taken / r.size)) for r in mixing.mix(before.withColumn("digest", F.sha2("text", 256)), carry="digest").collect() if r.taken}
    got = [(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in corpus_pipeline.mixture(spark, before, "").collect()]
    assert {k: got.count(k) for k in got} == times
    assert sum(d is None for d, _ in times) > 1
    pytest.importorskip("public_tokenizers")
    encoded = corpus_pipeline.encode(spark, before, "").collect()
    assert sorted(((r.doc_id, len(r.ids) > 0) for r in encoded), key=repr) == sorted(((r.doc_id, True) for r in before.collect()), key=repr)


def test_rows_that_repeat_all_columns(spark, tmp_path):
    """Of rows that repeat doc_id and text, with an id or without, exact duplicates leave one; the mixture takes rows alike."""
    rows = [(1, "one text of a few words", "en", "a", 5)] * 3 + [(None, "no id but a text", "en", "a", 5)] * 2 + [(2, "another text of words", "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(False)).withColumn("digest", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "0"))
    before = spark.read.parquet(str(tmp_path / "0"))
    once = corpus_pipeline.exact_dedup(spark, before, "").collect()
    assert sorted(((r.doc_id, r.text) for r in once), key=repr) == sorted({(r[0], r[1]) for r in rows}, key=repr)
    near = corpus_pipeline.near_dedup(spark, before, "").collect()
    assert sorted(((r.doc_id, r.text) for r in near), key=repr) == sorted(((r[0], r[1]) for r in rows), key=repr)
    mixed = [(r.doc_id, r.text) for r in corpus_pipeline.mixture(spark, before, "").collect()]
    assert set(mixed) == {(r[0], r[1]) for r in rows} and mixed.count((2, "another text of words")) == 2


def plain_mix(rows):
    """Words taken of each (doc_id, text, source): shares by weight with stops, seats one by one to the highest quotient, and
    each source's documents end to end in the seeded order."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    n = [sum(k for k, (*_, s) in zip(size, rows, strict=True) if s == x) for x in sources]
    weight, total = [(5, 2, 1)[k % 3] for k in range(len(sources))], sum(n)
    stopped: set = set()
    while True:
        free = [k for k in range(len(sources)) if k not in stopped]
        left, w = total - sum(3 * n[k] for k in stopped), sum(weight[k] for k in free)
        over = {k for k in free if Fraction(left * weight[k], w) > 3 * n[k]}
        if not over:
            break
        stopped |= over
    target = [Fraction(3 * n[k]) if k in stopped else Fraction(left * weight[k], w) for k in range(len(sources))]
    least = min((t for t in target if t > 0), default=0)
    seats = 8 * max(4096, -(-min(max(total, 0), math.ceil(100 * total / least)) // 8)) if least else 8 * 4096
    quota = [0] * len(sources)
    queue = [(-t, k) for k, t in enumerate(target) if t > 0]
    heapq.heapify(queue)
    for _ in range(seats if queue else 0):
        _, k = queue[0]
        quota[k] += 1
        heapq.heapreplace(queue, (-target[k] / (2 * quota[k] + 1), k))
    taken = {}
    for k, x in enumerate(sources):
        took = min(3 * n[k], (2 * total * quota[k] + seats) // (2 * seats))
        own = sorted((hashlib.md5(f"17:{d}".encode()).hexdigest(), d, z) for (d, _, s), z in zip(rows, size, strict=True) if s == x)
        start, whole = 0, took // max(n[k], 1)
        for _, d, z in own:
            taken[d] = z * whole + max(0, min(z, took - whole * n[k] - start))
            start += z
    return taken, dict(zip([d for d, *_ in rows], size, strict=True))


def test_mixture_against_a_plain_one(spark):
    r = random.Random(6)
    rows = [(k, " ".join(["word"] * r.choice([0, 1, 2, 5, 30, 200])), r.choice(["a", "b", "c", "c", "c", "d", None])) for k in range(150)] + [(900, None, "z")]
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    taken, size = plain_mix(rows)
    want = {d: max(1, int(Decimal(t) / Decimal(size[d]) + Decimal("0.5"))) for d, t in taken.items() if t}
    got = [x.doc_id for x in corpus_pipeline.mixture(spark, docs, "").collect()]
    assert {d: got.count(d) for d in set(got)} == want and {x.doc_id: x.taken for x in mixing.mix(docs).collect()} == taken


def test_stage_tables_go(spark, monkeypatch):
    kept: list = []
    same = lambda _, docs, __: docs.withColumn("n_chars", F.col("n_chars") + 1)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", same), ("two", same), ("three", same), ("last", same)])
    plain = corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda *a, **b: kept.append(plain(*a, **b)) or kept[-1])
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    stands = [os.path.isdir(x._written_at.removeprefix("file:")) for x in kept]
    assert stands == [False, False, True]
