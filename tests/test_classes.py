"""The lockstep classifiers against single fits by plain Newton steps."""

import numpy as np
import pytest

from branchwise.operators import classes as C
from branchwise.session import ship_package, stored


def newton(x, y, classes, c):
    """Minimum of 0.5 |w|^2 + c * loss over standardised x; two classes have one weight vector."""
    x1 = np.column_stack([np.ones(len(x)), x])
    k = 1 if classes == 2 else classes
    w = np.zeros((x1.shape[1], k))
    free = np.ones(x1.shape[1])
    free[0] = 0
    for _ in range(100):
        s = x1 @ w
        if k == 1:
            p = 1 / (1 + np.exp(-s))
            r = p - y[:, None]
        else:
            e = np.exp(s - s.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            r = p - np.eye(k)[y]
        g = (c * x1.T @ r + free[:, None] * w).T.ravel()
        h = np.zeros((len(g), len(g)))
        d = len(free)
        for a in range(k):
            for b in range(k):
                v = p[:, a] * ((a == b) - p[:, b])
                h[a * d : a * d + d, b * d : b * d + d] = c * (x1 * v[:, None]).T @ x1 + (a == b) * np.diag(free)
        step = np.linalg.lstsq(h, g, rcond=1e-12)[0]
        w = w - step.reshape(k, d).T
        if np.abs(step).max() < 1e-12:
            break
    return w


def macro_f1(y, p):
    out = []
    for k in set(y) | set(p):
        out.append(2 * ((y == k) & (p == k)).sum() / ((y == k).sum() + (p == k).sum()))
    return float(np.mean(out))


def predicted(w, x, classes):
    s = np.column_stack([np.ones(len(x)), x]) @ w
    return (s[:, 0] > 0).astype(int) if classes == 2 else s.argmax(axis=1)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 6)) * [1, 5, 0.1, 1, 1, 1] + [0, 100, 0, 0, 0, 0]
    x[:, 5] = 3.0  # a constant column
    s = np.column_stack([x[:, 0], -x[:, 0] + 10 * x[:, 2], x[:, 3]]) + rng.gumbel(size=(600, 3))
    y3, y2 = s.argmax(axis=1), (x[:, 1] - 100 + 3 * rng.normal(size=600) > 0).astype(int)
    folds = np.column_stack([rng.integers(-1, 5, 600), rng.integers(-1, 2, 600)])
    folds[:50, 1] = -2  # these rows are not in the second split
    return x, y2, y3, folds


def test_against_newton(spark, table):
    ship_package(spark)
    x, y2, y3, folds = table
    rows = [([1.0, *a], [int(v) if v > -2 else None for v in f], int(p), int(q)) for a, p, q, f in zip(x.tolist(), y2, y3, folds.tolist())]
    df = stored(spark.createDataFrame(rows, "z array<double>, folds array<int>, two int, three int").repartition(3), "class-rows")
    blocks, targets, cs = {"all": (1, 2, 3, 4, 5, 6), "some": (1, 3)}, {"two": 2, "three": 3}, (1e-2, 1.0)
    models = C.fit_all(df, blocks, targets, cs)
    for m in models:
        y = y2 if m.target == "two" else y3
        for j in range(0, len(m.split), 5):
            train = folds[:, m.split[j]] >= 0
            xs = x[:, [f - 1 for f in blocks[m.block]]]
            sd = xs[train].std(axis=0)
            xs = (xs - xs[train].mean(axis=0)) / np.where(sd > 1e-9, sd, 1)
            used = train & (folds[:, m.split[j]] != m.out[j])
            want = newton(xs[used], y[used], m.classes, m.c[j])
            got = m.w[j] - (m.w[j].mean(axis=1, keepdims=True) if m.classes > 2 else 0)  # the intercepts' common part is free
            want = want - (want.mean(axis=1, keepdims=True) if m.classes > 2 else 0)
            assert np.abs(got - want).max() < 2e-4
    scores = {(r.model, r.target, r.split): r for r in C.chosen_scores(df, list(targets), models, cs).collect()}
    assert len(scores) == 8
    for (block, target, split), r in scores.items():
        y, classes, f = (y2, 2, folds[:, split]) if target == "two" else (y3, 3, folds[:, split])
        xs = x[:, [i - 1 for i in blocks[block]]]
        sd = xs[f >= 0].std(axis=0)
        xs = (xs - xs[f >= 0].mean(axis=0)) / np.where(sd > 1e-9, sd, 1)
        means = []
        for c in cs:
            per = []
            for h in sorted(set(f[f >= 0])):
                used, held = (f >= 0) & (f != h), f == h
                per.append(macro_f1(y[held], predicted(newton(xs[used], y[used], classes, c), xs[held], classes)))
            means.append(np.mean(per))
        c = cs[int(np.argmax(means))]
        test = f == -1
        p = predicted(newton(xs[f >= 0], y[f >= 0], classes, c), xs[test], classes)
        assert r.c == c and r.n_test == test.sum()
        assert abs(r.macro_f1 - macro_f1(y[test], p)) < 1e-9 and abs(r.accuracy - (y[test] == p).mean()) < 1e-9


def test_one_class_in_a_part(spark):
    """A left-out fold whose rest has one class does not count, and an absent class is never predicted."""
    ship_package(spark)
    rng = np.random.default_rng(1)
    rows = [([1.0, float(rng.normal())], [0 if i < 40 else 1 if i < 80 else -1], int(i >= 40 and i % 2), int(i % 2 + (i >= 80))) for i in range(120)]
    df = stored(spark.createDataFrame(rows, "z array<double>, folds array<int>, two int, three int"), "class-rows")
    models = C.fit_all(df, {"x": (1,)}, {"two": 2, "three": 3}, (1.0,))
    two = next(m for m in models if m.target == "two")
    assert two.out.tolist() == [0, C.NONE]
    counts = C._counts(df, ["two", "three"], models).where("target = 'three'").collect()
    assert {r.pred for r in counts} <= {0, 1} and {r.label for r in counts if r.fold == -1} == {1, 2}


def test_sample_only_says_where_to_begin(spark, table, monkeypatch):
    """Models begun on a sample end where models begun at zero end: all rows decide."""
    ship_package(spark)
    x, y2, y3, folds = table
    rows = [([1.0, *a], [int(v) for v in f], int(p), int(q)) for a, p, q, f in zip(x.tolist(), y2, y3, folds.tolist())]
    df = stored(spark.createDataFrame(rows, "z array<double>, folds array<int>, two int, three int").repartition(3), "class-rows")
    used, slopes = [], C._slopes
    monkeypatch.setattr(C, "_slopes", lambda r, *a: used.append(r.count()) or slopes(r, *a))
    whole = C.fit_all(df, {"all": (1, 2, 3)}, {"two": 2, "three": 3}, (1.0,))
    assert set(used) == {600}
    monkeypatch.setattr(C, "START_ROWS", 80)
    begun = C.fit_all(df, {"all": (1, 2, 3)}, {"two": 2, "three": 3}, (1.0,))
    assert min(used) < 600 and used[-1] == 600
    for a, b in zip(whole, begun):
        centred = [m.w - (m.w.mean(axis=2, keepdims=True) if m.classes > 2 else 0) for m in (a, b)]
        assert np.abs(centred[0] - centred[1]).max() < 5e-4 and np.abs(a.f - b.f).max() < 1e-5


def test_few_passes_over_all_rows(spark, monkeypatch):
    """The Hessian near a sample's best point shapes the steps on all rows, so few are needed, and the end is the same."""
    ship_package(spark)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(16_000, 8)) @ (np.eye(8) + 0.5)
    y = (x @ rng.normal(size=(8, 3)) + rng.gumbel(size=(16_000, 3))).argmax(axis=1)
    rows = [([1.0, *a], [int(f)], int(b > 0), int(b)) for a, f, b in zip(x.tolist(), rng.integers(-1, 3, 16_000), y)]
    df = stored(spark.createDataFrame(rows, "z array<double>, folds array<int>, two int, three int").repartition(4), "class-rows")
    monkeypatch.setattr(C, "START_ROWS", 2000)
    passes, slopes = [], C._slopes
    monkeypatch.setattr(C, "_slopes", lambda r, *a: passes.append(r.count() == len(x)) or slopes(r, *a))
    begun = C.fit_all(df, {"all": tuple(range(1, 9))}, {"two": 2, "three": 3}, (1e-2, 1.0))
    assert sum(passes) <= 7
    monkeypatch.setattr(C, "START_ROWS", len(x))
    whole = C.fit_all(df, {"all": tuple(range(1, 9))}, {"two": 2, "three": 3}, (1e-2, 1.0))
    for a, b in zip(whole, begun):
        assert (np.abs(a.f - b.f) <= 1e-7 * np.abs(a.f)).all()
