"""The transfer study against plain fits on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchwise.operators import linear as L
from branchwise.operators import transfer as T
from branchwise.session import ship_package


def fit(x, y, fold):
    """Penalty by the folds, then all rows: intercept and raw coefficients."""
    sd = x.std(axis=0)

    def solve(on, a):
        m, my = x[on].mean(axis=0), y[on].mean()
        z = (x[on] - m) / sd
        w = np.linalg.solve(z.T @ z + a * np.eye(x.shape[1]), z.T @ (y[on] - my)) / sd
        return my - m @ w, w

    best = []
    for a in L.ALPHAS:
        out = []
        for h in sorted(set(fold)):
            b, w = solve(fold != h, a)
            out.append(r2(y[fold == h], b + x[fold == h] @ w))
        best.append(np.mean(out))
    return solve(np.ones(len(x), bool), L.ALPHAS[int(np.argmax(best))])


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_against_rows(spark):
    ship_package(spark)
    rng = np.random.default_rng(4)
    n = 900
    game = rng.integers(0, 60, n)
    cohort = np.where((game < 20) | ((game < 40) & (rng.random(n) < 0.5)), "big", "small")
    x = rng.normal(size=(n, 3)) + game[:, None] / 30
    y = x @ [1.0, -0.5, 0.2] + np.where(cohort == "big", 0.5 * x[:, 0], 0) + rng.normal(size=n)
    rows = [(i, int(game[i]), str(cohort[i]), bool(i % 3 == 0), [1.0, *x[i].tolist(), float(y[i])], float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, game int, cohort string, top boolean, z array<double>, y double").repartition(3)
    sided, name = T.sided(df)
    big = "big" if (cohort == "big").sum() >= n / 2 else "small"
    assert name == big
    placed = T.with_splits(sided, "game", [0, 1], 3, "id")
    got = {r.source: r for r in T.study(placed, [L.Model("y|x", (1, 2, 3), 4)], 2, 3, "top").collect()}
    at = {r.id: r for r in placed.collect()}
    side = np.array([at[i].side for i in range(n)])
    folds = np.array([at[i].folds for i in range(n)])
    both = set(game[side == 0]) & set(game[side == 1])
    shared = np.array([g in both for g in game])
    assert shared.tolist() == [at[i].shared for i in range(n)]
    ranks = {r.source: r.spearman for r in T.rank_correlations(placed, T.study(placed, [L.Model("y|x", (1, 2, 3), 4)], 2, 3, "top"), {"y": "y"}).collect()}
    for source in (0, 1):
        s, d, r = side == source, side != source, got[source]
        b, w = fit(x[s], y[s], folds[s, 2])
        p = b + x @ w
        new, train = d & ~shared, d & shared
        assert (r.n_source, r.n_dest, r.n_unseen, r.n_refit) == (s.sum(), d.sum(), new.sum(), train.sum())
        assert r.frozen_r2 == pytest.approx(r2(y[d], p[d])) and r.unseen_r2 == pytest.approx(r2(y[new], p[new]))
        top = d & (np.arange(n) % 3 == 0)
        assert r.band_r2 == pytest.approx(r2(y[top], p[top])) and r.n_band == top.sum()
        assert r.rmse == pytest.approx(np.sqrt(((y - p)[new] ** 2).mean())) and r.pearson == pytest.approx(np.corrcoef(y[new], p[new])[0, 1])
        assert (r.slope, r.intercept) == pytest.approx(tuple(np.polyfit(p[new], y[new], 1)))
        a, c = np.polyfit(p[train], y[train], 1)
        assert r.recalibrated_r2 == pytest.approx(r2(y[new], a * p[new] + c))
        b2, w2 = fit(x[train], y[train], folds[train, 3])
        assert r.refit_r2 == pytest.approx(r2(y[new], b2 + x[new] @ w2)) and r.cosine_raw == pytest.approx(w @ w2 / np.linalg.norm(w) / np.linalg.norm(w2))
        matched = []
        for k in range(3):
            on = s & (folds[:, 4 + k] >= 0)
            assert on.sum() == min(train.sum(), s.sum())
            b3, w3 = fit(x[on], y[on], folds[on, 4 + k])
            matched.append(r2(y[new], b3 + x[new] @ w3))
        assert r.size_matched_r2 == pytest.approx(np.mean(matched)) and r.n_draws == 3
        order = lambda v: np.argsort(np.argsort(v))
        assert ranks[source] == pytest.approx(np.corrcoef(order(y[new]), order(p[new]))[0, 1])
    assert not placed.where(F.size("folds") != 7).count()
