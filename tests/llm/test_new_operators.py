"""Centroid clusters, the n-gram Jaccard join and hard negatives against brute-force versions."""

import hashlib
import math
import os
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_llm_operators import SF, awkward

from branchwise.llm import centroids, jaccard, negatives
from branchwise.session import ship_package

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
CLASHES = ["cluster", "distance", "row", "r", "a", "akey", "vector", "dim", "label_", "anchor", "rank", "nth", "vec", "k1", "gram", "cid", "n", "bits", "comp"]
VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)


def vectors(n=None):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF}/embeddings.parquet").slice(0, n).to_pylist()]
    v = rows[3][1]
    return rows + [
        (10_000, v, 1), (10_000, v, 1), (10_001, v, 2), (None, v, 1), (None, rows[4][1], None), (10_002, None, 3), (10_003, [], 3),
        (10_004, v[:10], 3), (10_005, [*v[:63], None], 3), (10_006, [*v[:63], float("nan")], 3), (10_007, [*v[:63], float("inf")], 3),
        (10_100, [0.0] * 64, 4), (10_200, [-x for x in v], 1), (10_300, v, None), (10_400, [*v, 1.0], 1),
    ]


def frame(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], VECTORS).repartition(3)


def whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_clusters(rows, k, rounds, scale):
    kept = [(i, whole(v, scale)) for i, v, *_ in rows if finite(v) and len(v) == 64]
    name = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [r[1] for r in sorted(kept, key=name)[:k]]
    d = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for turn in range(rounds + 1):
        got = [(i, *min((d(x, c), j) for j, c in enumerate(centres))[::-1], x) for i, x in kept]
        if turn < rounds:
            for j in range(len(centres)):
                own = [x for _, c, _, x in got if c == j]
                centres[j] = [sum(col) // len(own) for col in zip(*own)] if own else centres[j]
    return Counter((i, j, dist) for i, j, dist, _ in got), centres


@pytest.mark.parametrize("k,rounds,scale", [(16, 3, 64), (5, 1, 3), (300, 2, 64)])
def test_centroids(spark, k, rounds, scale):
    rows = vectors(150)
    want, centres = brute_clusters(rows, k, rounds, scale)
    got, last, _ = centroids.clustered(frame(spark, rows), k=k, rounds=rounds, scale=scale)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got.collect()) == want and last.tolist() == centres
    full = centroids.with_inertia(got, last).collect()
    per = Counter()
    for (_, j, d), n in want.items():
        per[j] += d * n
    assert all(r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values()) for r in full)
    assert {r.centroid_sha256 for r in full if r.cluster == 0} <= {hashlib.sha256(",".join(map(str, centres[0])).encode()).hexdigest()}


def test_bounds_spare_scans(spark):
    """Vectors in tight families: after the first assignment few of them are scanned again, with the same result."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(8, 64))
    rows = [(i, (middle[i % 8] + 0.02 * rng.normal(size=64)).astype(np.float32).tolist(), 0) for i in range(800)]
    want, _ = brute_clusters(rows, 8, 3, 64)
    got, _, scanned = centroids.clustered(frame(spark, rows), k=8)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got.collect()) == want
    assert scanned[0] == 800 and scanned[-1] < 400


def test_loosening_holds_and_is_below_the_drift():
    rng = np.random.default_rng(3)
    less = 0
    for _ in range(300):
        old = rng.integers(-40, 40, (6, 4))
        new = old + rng.integers(-6, 7, (6, 4))
        radius = rng.uniform(0, 25, 6)
        bound, drift = centroids.loosening(old, new, radius), np.sqrt(((new - old) ** 2).sum(axis=1))
        ways = rng.normal(size=(200, 4))
        ways *= (rng.uniform(0, 1, 200) ** 0.1 / np.sqrt((ways**2).sum(axis=1)))[:, None]
        for a in range(6):
            x = old[a] + radius[a] * ways
            fall = np.sqrt(((x[:, None] - old) ** 2).sum(axis=2)) - np.sqrt(((x[:, None] - new) ** 2).sum(axis=2))
            assert (fall.max(axis=0) <= bound[a] + 1e-9).all() and (bound[a] <= drift + 1e-5).all()
        less += int((bound < drift[None, :] - 1e-3).sum())
    assert less > 3000


def test_large_components_are_exact_or_refused():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-(1 << 27), 1 << 27, (20, 64)), rng.integers(-(1 << 27), 1 << 27, (3, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    assert centroids.squared(x, c).tolist() == want
    with pytest.raises(ValueError):
        centroids.whole(np.array([1e30, 0.0]), 64, 2)


def test_residue_products():
    rng = np.random.default_rng(2)
    for top, d in ((3, 5), (300, 64), (1 << 20, 64), (1 << 27, 200), (1 << 28, 1)):
        a, b = rng.integers(-top, top + 1, (7, d)), rng.integers(-top, top + 1, (9, d))
        assert negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert negatives.products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2
    with pytest.raises(ValueError):
        negatives.products(np.full((1, 2), 1 << 31), np.full((1, 2), 1 << 31))
    assert 64 * (negatives.PRIMES[0] // 2) ** 2 < negatives.EXACT


def brute_negatives(rows, scale=256):
    kept = [(i, l, whole(v, scale)) for i, v, l in rows if finite(v) and l is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = Counter()
    for i, l, x in {(i, l, tuple(x)) for i, l, x in kept if i is not None and i % 100 == 0}:
        scored = [(j, dot(x, y), m) for j, m, y in kept]
        for p in sorted((s for s in scored if s[2] == l and s[0] != i), key=order)[:5]:
            near = [s for s in scored if s[2] != l and 30 * p[1] <= 100 * s[1] <= 90 * p[1]]
            for rank, s in enumerate(sorted(near, key=order)[:10], 1):
                out[(i, p[0], rank, s[0], p[1], s[1])] += 1
    return out


@pytest.mark.parametrize("cell", [8192, 40])
def test_negatives(spark, monkeypatch, cell):
    monkeypatch.setattr(negatives, "CELL_ROWS", cell)
    monkeypatch.setattr(negatives, "CELL_ANCHORS", max(2, cell // 40))
    rows = vectors()
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows)


def test_negatives_with_large_scores_and_ties(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rng.choice([-1e6, 0.0, 1e6], 64)], int(i % 3)) for i in rng.permutation(120)]
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows)


def brute_join(rows, words=3, least=90):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    distinct = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    above = {s: s for s in distinct}

    def top(s):
        while above[s] is not s:
            s = above[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * len(a & b) >= least * len(a | b):
                above[top(a)] = top(b)
    low: dict = {}
    for r, s in zip(rows, sets):
        if s and r[0] is not None:
            low[top(s)] = min(r[0], low.get(top(s), r[0]))
    return Counter((r[0], len(s), low.get(top(s)) if s else r[0]) for r, s in zip(rows, sets))


def near_copies():
    """A family around one text, a chain in which only neighbours link, and texts that share a rare passage."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(200)]
    out = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(200, rng.integers(0, 5), replace=False):
            w[at] = f"x{i}y{at}"
        out.append(" ".join(w))
    chain = [f"c{i}" for i in range(100)]
    out += [" ".join(chain[3 * i :] + [f"d{j}" for j in range(3 * i)]) for i in range(20)]
    shared = [f"s{i}" for i in range(15)]
    out += [" ".join(shared + [f"t{i}u{j}" for j in range(10)]) for i in range(30)]
    return [(2000 + i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("block,words,least", [(256, 3, 90), (4, 3, 90), (256, 2, 60), (256, 5, 80)])
def test_jaccard(spark, monkeypatch, block, words, least):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = [(r[0], r[1]) for r in awkward()] + near_copies()
    ship_package(spark)
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], schema).repartition(3)
    got = jaccard.joined(docs, words=words, least=least)
    assert Counter(map(tuple, got.collect())) == brute_join(rows, words, least)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    for _ in range(2000):
        both = rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64)
        a = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, rng.integers(0, 30)).astype(np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, rng.integers(0, 30)).astype(np.uint64)]))
        links = 100 * jaccard.overlap(a, b) >= 90 * len(np.union1d(a, b))
        assert links == (jaccard.overlap(a, b) >= jaccard.need(len(a), len(b), 90))
        assert not links or jaccard.may_link(jaccard.parity(a), jaccard.parity(b), len(a), len(b), 90)


def test_empty_tables(spark):
    ship_package(spark)
    none = frame(spark, [])
    docs = spark.createDataFrame([], "doc_id long, text string")
    rows, centres, _ = centroids.clustered(none)
    assert centroids.with_inertia(rows, centres).collect() == [] and jaccard.joined(docs).collect() == []
    assert negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).collect() == []
