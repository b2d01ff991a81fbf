"""Whitening, the prefix trie and SimHash: against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tokenledger.llm import simhash, trie, whitening
from tokenledger.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>, n int, x string"
TURNS = "conv_id long, turn long, role string, text string, depth int"
DOCS = "doc_id long, text string, fp int, component string"


@pytest.fixture
def narrow(spark):
    """Many small partitions, so that forests and buckets meet across tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- whitening --------------------------------------------------------------------------------------


@pytest.mark.parametrize("d, k", [(64, 8), (200, 8), (8, 8), (5, 5), (1, 1), (12, 3)])
def test_eigenpairs(d, k):
    rng = np.random.default_rng(d)
    c = rng.standard_normal((500, d)) * np.linspace(3, 1, d)
    c -= c.mean(0)
    v = c.T @ c
    values, vectors, residuals = whitening.eigenpairs(lambda w: v @ w, d, k, np.trace(v))
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], rtol=1e-12)
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-13 * values[0] * d and residuals.max() <= 64 * whitening.EPS * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13


def test_eigenpairs_of_equal_eigenvalues_and_few_steps():
    v = np.diag([5.0] * 4 + [1.0] * 30)
    values, vectors, _ = whitening.eigenpairs(lambda w: v @ w, 34, 6, np.trace(v), room=14)
    assert np.allclose(values, [5] * 4 + [1] * 2) and np.abs(v @ vectors - vectors * values).max() < 1e-12


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    _, s = np.linalg.eigh(a)
    x = (s[:, -1:] + 0.05 * rng.standard_normal((20, 1))) / 1
    x /= np.linalg.norm(x)
    theta = (x * (a @ x)).sum(axis=0)
    r = a @ x - x * theta
    t = whitening.corrections(lambda w: a @ w, np.zeros((20, 0)), x, theta, r, 60, 1e-12)
    p = np.eye(20) - x @ x.T
    assert np.abs(p @ (a @ t - t * theta) + r).max() < 1e-8 and abs((x * t).sum()) < 1e-10


def _whitened(rows, k):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return c @ u / np.sqrt(e), e / np.trace(c.T @ c / n), ((n * x - s) ** 2).sum(axis=1)


def test_whitening_with_odd_rows(spark):
    rng = random.Random(4)
    good = [(i, [float(np.float32(rng.gauss(0, 1) * (9 - j))) for j in range(9)]) for i in range(200)]
    good += [(5, good[5][1]), (None, good[7][1])]  # repeated, and without an id
    odd = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 7), (903, [math.nan] + [0.0] * 8), (904, [math.inf] + [0.0] * 8), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 3, "z") for r in good + odd], VECTORS).repartition(5)
    found = whitening.whiten(df).collect()
    want, explained, deviation = _whitened(good, 8)
    assert len(found) == 8 * len(good) and {r.n for r in found} == {len(good)}
    assert sorted((r.vec_id is None, r.vec_id or 0, int(r.deviation)) for r in found if r.component == 1) == sorted((i is None, i or 0, int(v)) for (i, _), v in zip(good, deviation, strict=True))
    for k in range(8):
        got = {r.vec_id: r.whitened for r in found if r.component == k + 1}
        own = {i: want[at, k] for at, (i, _) in enumerate(good)}
        sign = math.copysign(1, got[0] * own[0])
        assert max(abs(sign * got[i] - own[i]) for i in own) < 1e-9
        assert {r.explained for r in found if r.component == k + 1}.pop() == pytest.approx(explained[k], rel=1e-12)
    assert max(r.identity_error for r in found) < 1e-10 and max(r.residual for r in found) < 2e-14


def test_whitening_of_large_numbers_and_small_tables(spark):
    frame = lambda rows: spark.createDataFrame([(*r, 3, "z") for r in rows], VECTORS)
    assert whitening.whiten(frame([])).count() == whitening.whiten(frame([(1, [1.0, 2.0])])).count() == whitening.whiten(frame([(1, [1.0]), (2, [1.0])])).count() == 0
    rows = [(1, [1e6, 2.0]), (2, [-1e6, 2.0]), (3, [1e6, 5.0])]
    found = whitening.whiten(frame(rows)).collect()
    _, _, exact = _whitened(rows, 2)
    assert len(found) == 6 and {r.vec_id: int(r.deviation) for r in found} == {i: sum((3 * a - b) ** 2 for a, b in zip([math.floor(1024 * c) + 100000 for c in v], [sum(math.floor(1024 * w[j]) + 100000 for _, w in rows) for j in (0, 1)], strict=True)) for i, v in rows}
    assert whitening.whiten(frame([(1, [1e300, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])])).count() == 3  # beyond 2^30 as 2^30, beside which the other component has no variance
    line = whitening.whiten(frame([(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1}  # the other has no variance


# --- prefix trie ------------------------------------------------------------------------------------


def _trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    nodes, kids, leaves, saved = {}, {}, {}, {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        said = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), ([], []))[0].append(c)
        nodes[tuple(said)][1].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, (m, _) in nodes.items():
        spared = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] = saved.get(k[:d], 0) + spared
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
    digest = lambda e: hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(nodes[k[:-1]][0]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k], digest(e)) for k, (m, e) in nodes.items()), key=repr)


def _conversations(seed, count, low=0):
    r = random.Random(seed)
    rows = [(None, 1, "user", "lost"), (low + 3, None, None, None)]
    for c in range(low, low + count):
        said = [(r.choice(["user", "tool", None]), r.choice(["x y", "z", "p\tq  r", "", None]) if t < 4 else str(r.randrange(60))) for t in range(r.randrange(1, 8))]
        rows += [(c, t, *x) for t, x in enumerate(said)]
    return rows


@pytest.mark.parametrize("seed, low, fan", [(1, 0, 64), (2, -45, 2), (3, 7, 2)])
def test_trie_against_brute_force(spark, narrow, seed, low, fan):
    rows = _conversations(seed, 150, low)
    random.Random(seed).shuffle(rows)
    found = trie.prefix_trie(spark.createDataFrame([(*r, 1) for r in rows], TURNS), fan=fan).collect()
    assert sorted(map(tuple, found), key=repr) == _trie(rows)


def test_trie_of_copies_prefixes_and_long_conversations(spark, narrow):
    """Over half of the conversations are one; some are prefixes of others; one is long; some end up without turns."""
    rows = [(c, t, "user", f"word {t}") for c in range(0, 4000, 20) for t in range(3 if c % 3 else 2)]
    rows += [(c, t, "user", f"turn {t}") for c in (1, 21, 41) for t in range(700 + c)] + [(c, 0, "user", "own") for c in range(9001, 9020)]
    found = trie.prefix_trie(spark.createDataFrame([(*r, 1) for r in rows], TURNS), fan=2).collect()
    assert sorted(map(tuple, found), key=repr) == _trie(rows)
    assert any(zlib.crc32(str(c).encode()) % 4 for c in range(9001, 9020))  # their base is absent, so they have no turns


def test_trie_of_equal_turns_and_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(empty).count() == 0
    ties = [(1, 1, "b", "x"), (1, 1, "a", "x"), (1, 1, "a", "x"), (2, None, "a", "y"), (2, None, None, None)]
    one = sorted(map(tuple, trie.prefix_trie(spark.createDataFrame([(*r, 1) for r in ties], TURNS)).collect()), key=repr)
    two = sorted(map(tuple, trie.prefix_trie(spark.createDataFrame([(*r, 1) for r in ties[::-1]], TURNS).repartition(3)).collect()), key=repr)
    assert one == two


def test_end_digests_of_a_large_class(spark, narrow):
    ids = list(range(-50, 5000))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([("a" if i % 7 else "b", i) for i in ids], "class string, conv_id long").repartition(6)
    found = {r[0]: r[1] for r in trie.end_digests(df, most=64).collect()}
    assert found == {c: hashlib.sha256(",".join(str(i) for i in sorted(ids) if (i % 7 != 0) == (c == "a")).encode()).hexdigest() for c in "ab"}


# --- SimHash ----------------------------------------------------------------------------------------


def _fingerprint(text, words=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows, bits=4):
    fps = np.array([_fingerprint(t) for _, t in rows], np.uint64)
    top, least = list(range(len(rows))), {}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits).tolist():
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{int(fps[i]):016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_fingerprints():
    r = random.Random(2)
    texts = ["", " \n", "one", "One TWO three", "a b c d", "É é ü", "x " * 9] + [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(4, 400))) for _ in range(30)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == _fingerprint(t)
    parts = [w for p in simhash._parts(b"aa bb\ncc  dd " * 50, 7) for w in p]
    assert parts == (b"aa bb\ncc  dd " * 50).split()
    long = "w%d " * 3 % (1, 2, 3) * 200_000  # over several parts
    assert simhash.fingerprint(long.encode()) == _fingerprint(long)


def test_variants_meet_whatever_bits_differ(spark):
    assert simhash.segments(4) == [(0, 22, True), (22, 22, True), (44, 20, False)]
    assert simhash.segments(1) == [(0, 64, True)] and simhash.segments(0) == [(0, 64, False)] and len(simhash.segments(5)) == 3
    r = random.Random(3)
    for bits in (0, 1, 2, 3, 4, 6):
        assert sum(w for _, w, _ in simhash.segments(bits)) == 64
        pairs = []
        for k in range(200):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), bits):
                y ^= 1 << b
            pairs += [(k, x), (k, y)]
        df = spark.createDataFrame([(k, x - (x >> 63 << 64)) for k, x in pairs], "k int, fp long")
        met = simhash.variants(df.select("fp").distinct(), bits).join(df, "fp").groupBy("k", "bucket").count().where("count > 1").select("k").distinct().count()
        assert met == 200
    some = spark.createDataFrame([(r.getrandbits(62),)], "fp long")
    assert simhash.variants(some, 4).count() == simhash.variants(some, 4).select("bucket").distinct().count() == 45


@pytest.mark.parametrize("most", [8192, 4])
def test_simhash_components_against_all_pairs(spark, narrow, most):
    """A dense group of near copies, chains, copies, rows without words, ids or text; with `most` 4 through the blocks."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(220)]
    rows = [(None, None), (None, "solo text here now"), (7, ""), (5, "A b"), (6, "a  B"), (6, "a b"), (8, None)]
    for k in range(160):
        w = list(base)
        for _ in range(r.randrange(0, 30)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w)))
    for k in range(60):
        base[r.randrange(len(base))] = f"y{k}"  # a chain
        rows.append((2000 - k, " ".join(base)))
    rows += [(3000 + k, " ".join(r.choice("abcdefghij") for _ in range(30))) for k in range(100)]
    found = simhash.near_duplicates(spark.createDataFrame([(*x, 1, "c") for x in rows], DOCS).repartition(4), most=most).collect()
    want = _components(rows)
    assert sorted(map(tuple, found), key=repr) == want and 3 < len({x[2] for x in want}) < len(rows)


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("bits", [2, 4])
def test_spanning_links(bits):
    r = random.Random(6)
    fps = np.array(list({r.getrandbits(6) << 3 for _ in range(40)}), np.uint64)
    top = {int(x): int(x) for x in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = simhash._spanning(fps, bits)
    for a, b in links:
        assert bin(int(a) ^ int(b)).count("1") <= bits and find(int(a)) != find(int(b))
        top[find(int(a))] = find(int(b))
    for a in fps.tolist():
        for b in fps.tolist():
            assert bin(a ^ b).count("1") > bits or find(a) == find(b)


def test_query_columns(spark):
    data = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(data):
        pytest.skip("no tables")
    assert QUERIES["op11_jacobi_davidson_whitening"](spark, data).columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert QUERIES["op13_deletion_variant_simhash"](spark, data).columns == ["doc_id", "fingerprint", "component_id"]
