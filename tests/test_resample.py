import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchwise.operators import resample as R


def cohort(spark, shift=0.0, mix=(0.3, 0.1), n=(700, 500), seed=4):
    """Two cohorts over six strata with different composition and stratum levels."""
    rng = np.random.default_rng(seed)
    base = rng.uniform(-1, 1, 6)
    rows = []
    for name, count, lead, add in (("original", n[0], mix[0], 0.0), ("r1", n[1], mix[1], shift)):
        p = np.array([lead] + [(1 - lead) / 5] * 5)
        st = rng.choice(6, count, p=p)
        vals = base[st] + rng.normal(0, 0.3, count) + add
        rows += [(f"{name}{i}", name, f"s{s}", float(v)) for i, (s, v) in enumerate(zip(st, vals))]
    return spark.createDataFrame(rows, "id string, cohort string, st string, v double")


def diff(df):
    return R.stratified_difference(df, "id", "cohort", "st", ["v"], "original", 300).first()


def test_composition_alone_does_not_fire(spark):
    # A 95% interval misses one sample in twenty, so several samples are drawn.
    fired = [diff(cohort(spark, 0.0, (0.6, 0.05), seed=s))["differs"] for s in range(5)]
    assert sum(fired) <= 1


def test_real_shift_fires(spark):
    r = diff(cohort(spark, 0.25, (0.6, 0.05)))
    assert r["differs"] and r["boot_mean"] == pytest.approx(-0.25, abs=0.08)


def test_one_sided_stratum_is_skipped(spark):
    df = cohort(spark)
    extra = spark.createDataFrame([(f"x{i}", "r1", "only", 99.0) for i in range(50)], df.schema)
    assert abs(diff(df.unionByName(extra))["boot_mean"]) < 0.1


def test_no_shared_strata_gives_no_interval(spark):
    df = cohort(spark).withColumn("st", F.concat("cohort", "st"))
    assert R.stratified_difference(df, "id", "cohort", "st", ["v"], "original", 50).count() == 0


def test_weights_are_poisson_and_stable(spark):
    coef = R.coefficients(0, 400)
    h = np.random.default_rng(0).integers(0, R.PRIME, 3000)
    w = R.weights(h, coef)
    assert w.mean() == pytest.approx(1.0, abs=0.01) and w.var() == pytest.approx(1.0, abs=0.02)
    assert np.array_equal(w, R.weights(h, R.coefficients(0, 400)))


def test_interval_width_matches_theory(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(2.0, 1.0, 2000)
    df = spark.createDataFrame([(f"r{i}", "a", float(v)) for i, v in enumerate(x)], "id string, arm string, v double")
    r = R.row_bootstrap(df, "id", "v", ["arm"], 1000).first()
    se = x.std(ddof=1) / np.sqrt(len(x))
    assert r["boot_mean"] == pytest.approx(x.mean(), abs=se) and r["hi"] - r["lo"] == pytest.approx(3.92 * se, rel=0.15)


def test_cluster_interval_is_wider_for_repeated_rows(spark):
    rng = np.random.default_rng(2)
    g = rng.normal(0, 1, 60)
    rows = [(f"r{i}", f"g{i % 60}", "a", float(g[i % 60])) for i in range(1200)]
    df = spark.createDataFrame(rows, "id string, g string, arm string, v double")
    a = R.cluster_bootstrap(df, "g", "v", ["arm"], 500).first()
    b = R.row_bootstrap(df, "id", "v", ["arm"], 500).first()
    assert a["hi"] - a["lo"] > 3 * (b["hi"] - b["lo"])


def test_partitioning_does_not_change_sums(spark):
    df = cohort(spark)
    a = R.replicate_sums(df.repartition(1), "id", ["v"], ["cohort"], 20).orderBy("cohort", "rep").collect()
    b = R.replicate_sums(df.repartition(7), "id", ["v"], ["cohort"], 20).orderBy("cohort", "rep").collect()
    assert [(r["w"], round(r["v"], 9)) for r in a] == [(r["w"], round(r["v"], 9)) for r in b]


def test_sign_stability_keeps_unscored_splits(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", -1.0), ("b", 1.0), ("c", None), ("d", -0.001)], "m string, v double")
    got = {r["m"]: r for r in R.sign_stability(df, ["m"], "v").collect()}
    assert got["a"]["consistent"] and got["a"]["n_scored"] == 2 and got["a"]["n_splits"] == 3
    assert not got["b"]["consistent"] and not got["c"]["consistent"] and got["c"]["mean"] is None
    assert got["d"]["sd"] == 0.0
    nulls = {r["m"] for r in R.null_candidates(R.sign_stability(df, ["m"], "v")).collect()}
    assert nulls == {"b", "c", "d"}


@pytest.mark.parametrize("size", [7, 40, 10_000])
def test_rank_bootstrap_equals_plain_resampling(spark, size):
    """Median and AUROC of every replicate, with ties, a value that fills a third of the rows, and ranges of few rows."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random(240) < 0.33, 2.0, np.round(rng.normal(size=240), 1))
    y = (x + rng.normal(size=240) > 1).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y int").repartition(3)
    h = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % R.PRIME for i in range(240)])
    w = R.weights(h, R.coefficients(4, 50))
    medians, areas = [], []
    for k in range(50):
        order = np.argsort(x, kind="stable")
        upto = np.cumsum(w[order, k])
        medians.append(x[order][np.searchsorted(2 * upto, upto[-1])])
        p, n = w[:, k] * y, w[:, k] * (1 - y)
        areas.append(sum(p[i] * (n[x < x[i]].sum() + n[x == x[i]].sum() / 2) for i in range(240)) / (p.sum() * n.sum()))
    for label, want in ((None, medians), ("y", areas)):
        got = R.rank_bootstrap(df, "id", "x", label, 50, 4, size).first()
        assert got.n_reps == 50 and got.boot_mean == pytest.approx(np.mean(want))
        assert (got.lo, got.hi) == pytest.approx(tuple(np.percentile(want, [2.5, 97.5])))


def test_reference_is_the_largest_cohort_and_tiny_ones_stay_out(spark):
    rows = [("a", "x")] * 30 + [("b", "x")] * 20 + [("b", "y")] * 20 + [("c", "z")] * 5 + [(None, "x")] * 60
    df = spark.createDataFrame(rows, "cohort string, kind string")
    kept, ref = R.compared(df, "cohort")
    assert ref == "b" and kept.count() == 70
    got = [tuple(r) for r in R.shared_strata(kept, "cohort", "kind", ref).collect()]
    assert got == [("a", 1, 2)]
    none, ref = R.compared(df.where("cohort = 'c'"), "cohort")
    assert ref is None and none.count() == 0 and R.shared_strata(none, "cohort", "kind", ref).count() == 0


def test_many_strata_in_few_rows(spark, monkeypatch):
    """Strata dealt whole to tasks give what joined replicate sums give, and no task emits strata x replicates rows."""
    rng = np.random.default_rng(8)
    rows = [(f"i{i}", str(rng.choice(["a", "b", "c"], p=[0.5, 0.3, 0.2])), int(rng.integers(0, 200) if i > 400 else 7), float(rng.normal()), float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, cohort string, st int, v double, u double").repartition(4)
    run = lambda: {(r["other"], r["metric"]): r for r in R.stratified_difference(df, "id", "cohort", "st", ["v", "u"], "a", 60).collect()}
    got = {}
    for size in (0, 300, 10_000):
        monkeypatch.setattr(R, "STRATUM_ROWS", size)
        got[size] = run()
    assert set(got[0]) == {(c, m) for c in "bc" for m in "vu"}
    for size in (300, 10_000):
        for k, r in got[0].items():
            assert [r[c] for c in ("n_reps", "boot_mean", "lo", "hi")] == pytest.approx([got[size][k][c] for c in ("n_reps", "boot_mean", "lo", "hi")])
    args = (df, "id", "cohort", "st", ["v"], "a", 60, 0)
    assert R._small_strata(*args).count() <= 60 * 2 * df.repartition("st").rdd.getNumPartitions()
