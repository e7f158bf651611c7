import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchwise.operators import decision_loss as D
from branchwise.operators import learners as M
from branchwise.operators import linear as L
from branchwise.plans import study, learner_queries, model_queries

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(7)
N, K = 240, 5
X = RNG.normal(size=(N, K)) * np.array([1, 2, 0.5, 30, 1]) + np.array([0, 1, 5, 100, 0])
Y = X @ np.array([1.0, -0.5, 2.0, 0.02, 0.0]) + RNG.normal(size=N) * 0.4
FOLD = np.where(np.arange(N) % 4 == 0, -1, (np.arange(N) // 4) % 5)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, [1.0, *map(float, X[i]), float(Y[i])], [int(FOLD[i])], float(Y[i])) for i in range(N)]
    return spark.createDataFrame(data, "id int, z array<double>, folds array<int>, y double").repartition(5).cache()


def direct(tr, te, alpha, mu=None, sd=None):
    mu = X[tr].mean(0) if mu is None else mu
    sd = X[tr].std(0) if sd is None else sd
    a, b = (X[tr] - mu) / sd, (X[te] - mu) / sd
    am, ym = a.mean(0), Y[tr].mean()
    w = np.linalg.solve((a - am).T @ (a - am) + alpha * np.eye(K), (a - am).T @ (Y[tr] - ym))
    return (b - am) @ w + ym


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_ridge_equals_direct_fit(spark, rows):
    m = L.Model("m", (1, 2, 3, 4, 5), 6)
    fits = L.fit_models(L.fold_grams(rows), [m], ["seed_ix"], oof=True).collect()
    train, test = FOLD >= 0, FOLD < 0
    mu, sd = X[train].mean(0), X[train].std(0)
    means = []
    for a in L.ALPHAS:
        sc = [r2(Y[FOLD == f], direct(train & (FOLD != f), FOLD == f, a, mu, sd)) for f in range(5)]
        means.append(np.mean(sc))
    alpha = L.ALPHAS[int(np.argmax(means))]
    final = next(r for r in fits if r["fold"] == -1)
    assert final["alpha"] == alpha
    assert final["r2"] == pytest.approx(r2(Y[test], direct(train, test, alpha)), abs=1e-9)
    seeded = L.with_predictions(L.seeded_rows(rows), L.fit_models(L.fold_grams(rows), [m], ["seed_ix"], oof=True), ["m"])
    got = {r["id"]: r["p_m"] for r in seeded.select("id", "p_m").collect()}
    for f in range(-1, 5):
        tr = train if f < 0 else train & (FOLD != f)
        want = direct(tr, FOLD == f, alpha)
        assert [got[i] for i in np.flatnonzero(FOLD == f)] == pytest.approx(list(want), abs=1e-8)


def test_nested_block_and_constant_column(spark):
    data = [([1.0, float(x[0]), 3.0, float(y)], [int(f)]) for x, y, f in zip(X, Y, FOLD)]
    df = spark.createDataFrame(data, "z array<double>, folds array<int>")
    fits = L.fit_models(L.fold_grams(df), [L.Model("a", (1,), 3), L.Model("b", (1, 2), 3)], ["seed_ix"]).collect()
    assert fits[0]["r2"] == pytest.approx(fits[1]["r2"], abs=1e-12)


def test_group_block_equals_wide_ridge(spark):
    games = RNG.integers(0, 12, N)
    y = games * 0.3 + RNG.normal(size=N)
    df = spark.createDataFrame([(0, int(f), int(g), float(v)) for f, g, v in zip(FOLD, games, y)], "seed_ix int, fold int, g int, y double")
    got = L.group_ceiling(df, "g", "y", alphas=(10.0,)).first()
    tr, te = FOLD >= 0, FOLD < 0
    one = np.eye(12)[games]
    mu, sd = one[tr].mean(0), one[tr].std(0)
    a, b = (one[tr] - mu) / sd, (one[te] - mu) / sd
    w = np.linalg.solve(a.T @ a + 10.0 * np.eye(12), a.T @ (y[tr] - y[tr].mean()))
    assert got["r2"] == pytest.approx(r2(y[te], b @ w + y[tr].mean()), abs=1e-9)


def test_ranks_auroc_and_spearman(spark):
    a = np.round(RNG.normal(size=300), 1)
    b = np.round(a + RNG.normal(size=300), 1)
    lab = (a + RNG.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([("g", float(x), float(y), int(z)) for x, y, z in zip(a, b, lab)], "g string, a double, b double, y int")
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert L.spearman(df, ["g"], "a", "b").first()["spearman"] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    pos, neg = b[lab == 1], b[lab == 0]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert L.auroc(df, ["g"], "y", "b").first()["auroc"] == pytest.approx(want)


def test_class_metrics(spark):
    df = spark.createDataFrame([("g", "a", "a"), ("g", "a", "b"), ("g", "b", "b"), ("g", "c", "b")], "g string, y string, p string")
    r = L.class_metrics(df, ["g"], "y", "p").first()
    assert r["accuracy"] == 0.5 and r["macro_f1"] == pytest.approx((2 / 3 + 1 / 2 + 0) / 3)


def test_layer_report(spark):
    from branchwise.plans.model_queries import layer_report

    s = spark.createDataFrame([(0, 0.01, True), (1, 0.05, True), (2, 0.08, True), (3, 0.06, False)], "layer int, mean double, consistent boolean")
    r = layer_report(s).first()
    assert (r["best_layer"], r["first_layer"], r["monotone"], r["share_consistent"]) == (2, 1, False, 0.75)


def test_tfidf_weights(spark):
    docs = spark.createDataFrame([(0, "Red cat sat. a"), (1, "red CAT ran"), (2, "red dog")], "d int, t string")
    tf = M.terms(docs, "d", "t")
    assert {(r["term"], r["tf"]) for r in tf.where("d = 0").collect()} == {("red", 1), ("cat", 1), ("sat", 1), ("red cat", 1), ("cat sat", 1)}
    v = M.vocabulary(tf, F.lit(3), 10, 2)
    assert [r["term"] for r in v.orderBy("ix").collect()] == ["cat", "red", "red cat"]
    w = {(r["d"], r["term"]): r["w"] for r in M.tfidf(tf, v, "d").collect()}
    idf = {"red": np.log(4 / 4) + 1, "cat": np.log(4 / 3) + 1, "red cat": np.log(4 / 3) + 1}
    norm = np.sqrt(sum(x * x for x in idf.values()))
    assert w[(0, "cat")] == pytest.approx(idf["cat"] / norm) and w[(2, "red")] == pytest.approx(1.0)


def surrogate(hat, q):
    """The loss written out: worst action under 2 * predicted - true, plus the best value, minus twice the prediction of the truly best action."""
    return np.max(2 * hat - q, 1) + np.max(q, 1) - 2 * np.take_along_axis(hat, q.argmax(1)[:, None], 1)[:, 0]


def test_text_penalty_uses_five_folds(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 5) for i in range(600)], "doc_id long, quality int")
    docs.createOrReplaceTempView("documents"), labels.createOrReplaceTempView("labels")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(learner_queries, "table", lambda spark, sf, name: spark.table(name))
        folds = {r["fold"] for r in learner_queries._labelled(spark, "").select("fold").distinct().collect()}
    assert folds == {-1, 0, 1, 2, 3, 4}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_study_queries_hold_every_curve_scheme_and_class_target(spark):
    sweep = model_queries.layer_sweep(spark, SF).collect()
    assert {(r.curve, r.layer) for r in sweep} == {(c, i) for c in ("qc", "qi", "tau", "qi_top") for i in range(4)} and len(sweep) == 16
    classes, values = {"continue_success", "oracle_action"}, {"qc", "qi", "tau"}
    for query, targets in ((model_queries.ridge_battery, values), (model_queries.class_battery, classes)):
        battery = query(spark, SF).collect()
        cells = {(s, i, t, b) for s in study.SCHEMES for i in range(5) for t in targets for b in study.feature_blocks()}
        assert {(r.scheme, r.seed_ix, r.target, r.model) for r in battery} == cells and len(battery) == len(cells)
        assert all(r.n_test > 0 and (r.model != "observables" or r.delta == 0) for r in battery)
    fixed = learner_queries.fixed_split_selection(spark, SF).collect()
    blocks = {"observables", "layer0", "layer1", "layer2", "layer3", "combined"}
    assert {(r.target, r.model) for r in fixed} == {(t, b) for t in classes | values for b in blocks} and len(fixed) == 30
    assert all((r.macro_f1 is None) == (r.target in values) for r in fixed)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_model_comparison_has_five_splits_both_scopes_and_own_values(spark, monkeypatch):
    monkeypatch.setattr(M, "FOREST", M.FOREST | {"numTrees": 4})  # the table's shape, not the forest, is tested
    got = learner_queries.model_comparison(spark, SF).collect()
    names = ("linear", "forest", "text", "vectors", "obs_vectors")
    assert {(r.scope, r.model) for r in got} == {(s, m) for s in ("overall", "top_band") for m in names} and len(got) == 10
    overall = [r for r in got if r.scope == "overall"]
    assert all(r.n_scored == 5 and r.r2_sd > 0 and r.regret_p90 >= 0 and abs(r.share_continue + r.share_intervene + r.share_quit - 1) < 1e-5 for r in overall)
    # Own values are in use: each model acts on a continue value of its own.
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS text_id", "text")
    rows = learner_queries.Y.study_rows(spark, SF, seeds=[0]).withColumn("text_id", F.expr(f"part_id % {docs.count()}"))
    p = learner_queries._compared(rows, "overall", True, learner_queries._text_model(rows, docs, 1))
    own = {r.model: r.s for r in p.groupBy("model").agg(F.round(F.sum(F.col("own_qc") * F.col("own_qc")), 6).alias("s")).collect()}
    assert len(set(own.values())) == 5


def test_decision_loss_bounds_regret():
    q = np.column_stack([RNG.normal(size=(20000, 2)), np.zeros(20000)])
    hat = np.column_stack([RNG.normal(size=(20000, 2)), np.zeros(20000)])
    regret = q.max(1) - q[np.arange(len(q)), hat.argmax(1)]
    assert (surrogate(hat, q) >= regret - 1e-12).all() and surrogate(q, q) == pytest.approx(np.zeros(len(q)))
    # the training direction is the slope of the loss
    step = 1e-7
    g = D.pull(hat[:, None, :2], q[:, :2])[:, 0]
    for k in (0, 1):
        moved = hat.copy()
        moved[:, k] += step
        off = np.abs((surrogate(moved, q) - surrogate(hat, q)) / step - g[:, k])
        assert np.mean(off > 1e-4) < 1e-3  # kinks


def plain_adam(x, q, lam, steps):
    """The same optimiser written out for one in-memory model."""
    w, b, out = np.zeros((x.shape[1], 2)), np.zeros(2), []
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros(2), np.zeros(2)]
    for t in range(1, steps + 1):
        hat = np.column_stack([x @ w + b, np.zeros(len(x))])
        s = np.zeros_like(hat)
        s[np.arange(len(x)), (2 * hat - q).argmax(1)] += 2
        s[np.arange(len(x)), q.argmax(1)] -= 2
        g = s[:, :2] / len(x)
        for i, (p, gr) in enumerate(((w, x.T @ g + lam * w), (b, g.sum(0)))):
            m[2 * i] = 0.9 * m[2 * i] + 0.1 * gr
            m[2 * i + 1] = 0.999 * m[2 * i + 1] + 0.001 * gr**2
            p -= 0.01 * (m[2 * i] / (1 - 0.9**t)) / (np.sqrt(m[2 * i + 1] / (1 - 0.999**t)) + 1e-8)
        out.append((w.copy(), b.copy()))
    half = out[steps // 2 :]
    return np.mean([h[0] for h in half], 0), np.mean([h[1] for h in half], 0)


@pytest.mark.parametrize("rows_per_task,steps", [(1000, 60), (150, 6)])
def test_decision_fit_equals_plain_optimiser(spark, monkeypatch, rows_per_task, steps):
    n = 300
    monkeypatch.setattr(D.train_stack, "__defaults__", (*D.train_stack.__defaults__[:-1], rows_per_task))
    x = RNG.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 2, 9]
    z = (x - [0, 2, 9]) / [1, 5, 0.2]
    q = np.column_stack([z @ [1.0, 0, 0.5], z @ [0, 1.0, -0.5]])
    fold = np.arange(n) % 4 - 1
    rows = [([1.0, *map(float, a), float(b[0]), float(b[1])], int(f)) for a, b, f in zip(x, q, fold)]
    df = spark.createDataFrame(rows, "z array<double>, fold int").repartition(4)
    coef, lam, scores = D.fit_cv(df, 4, (4, 5), lambdas=(1e-3, 1e2), steps=steps)
    tr = fold >= 0
    mu, sd = x[tr].mean(0), x[tr].std(0)
    full = np.column_stack([q, np.zeros(n)])
    w, b = plain_adam((x[tr] - mu) / sd, full[tr], 1e-3, steps)
    assert lam in (1e-3, 1e2) and (steps < 60 or scores[1e-3] < scores[1e2])
    w, b = plain_adam((x[tr] - mu) / sd, full[tr], lam, steps)
    assert coef[1:] == pytest.approx(w / sd[:, None], abs=1e-9)
    assert coef[0] == pytest.approx(b - mu @ (w / sd[:, None]), abs=1e-9)
    hat = np.column_stack([np.column_stack([np.ones(n), x]) @ coef, np.zeros(n)])
    assert surrogate(hat, full)[tr].mean() < (0.7 if steps >= 60 else 1.0) * surrogate(np.zeros_like(full), full)[tr].mean()


def test_decision_steps_equal_the_slope_and_need_no_barrier(spark, monkeypatch):
    """A block's gradient is the sum of the rows' slopes, and all fits, the final ones too, share their passes."""
    x, q, fold = RNG.normal(size=(700, 4)), RNG.normal(size=(700, 2)), RNG.integers(-1, 3, 700)
    coef, out = RNG.normal(size=(4, 3, 2)), np.array([0, 2, -1])
    used = (fold[:, None] >= 0) & (fold[:, None] != out[None, :])
    want = np.tensordot(x.T, D.pull(np.tensordot(x, coef, 1), q) * used[:, :, None], 1)
    assert D._gradients(x, np.concatenate([q, D._best(q)], axis=1), fold, out, coef) == pytest.approx(want, abs=1e-9)
    seen, stack = [], D.train_stack
    monkeypatch.setattr(D, "train_stack", lambda *a: seen.append(a[3]) or stack(*a))
    rows = [([1.0, *map(float, a[:2]), *map(float, b)], int(f)) for a, b, f in zip(x, q, fold)]
    D.fit_cv(spark.createDataFrame(rows, "z array<double>, fold int"), 3, (3, 4), lambdas=(1e-2, 1.0), steps=3)
    assert len(seen) == 1 and sum(j.held_out is None for j in seen[0]) == 2


def test_terms_move_as_texts(spark):
    """Repeated ids merge, and weights follow from one exchange of the texts."""
    docs = spark.createDataFrame([(1, "a1 b2 a1"), (1, "b2 c3"), (2, None), (3, "a1")], "id int, text string").repartition(3)
    tf = M.terms(docs, "id", "text")
    assert {tuple(r) for r in tf.collect()} == {(1, "a1", 2), (1, "b2", 2), (1, "c3", 1), (1, "a1 b2", 1), (1, "b2 a1", 1), (1, "b2 c3", 1), (3, "a1", 1)}
    vocab = spark.createDataFrame([("a1", 0, 1.0), ("b2", 1, 2.0)], "term string, ix int, idf double")
    w = M.tfidf(tf, vocab, "id")
    assert w._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got, x = {(r["id"], r["term"]): r["w"] for r in w.collect()}, 1 + np.log(2)
    assert got == pytest.approx({(1, "a1"): x / np.hypot(x, 2 * x), (1, "b2"): 2 * x / np.hypot(x, 2 * x), (3, "a1"): 1.0})


def test_rounding_does_not_choose_the_penalty(spark):
    """Scores that differ by the order of their sums only are equal, and the smaller penalty of equals is taken."""
    rows = [(0, 1.0, 0.1), (0, 10.0, 0.1 + 3e-16), (0, 1e6, 0.1 + 1e-14), (1, 1.0, 0.1), (1, 10.0, 0.1 + 1e-9), (2, 1.0, None), (2, 10.0, -0.5), (3, 1.0, None), (3, 10.0, None)]
    got = L.best_alpha(spark.createDataFrame(rows, "seed_ix int, alpha double, cv double")).collect()
    assert {r["seed_ix"]: r["alpha"] for r in got} == {0: 1.0, 1: 10.0, 2: 10.0, 3: 1.0}


def test_terms_are_counted_in_one_piece_a_text(spark):
    """Where ids differ, a text's terms come counted, with no aggregation after; known terms leave alone; letters are Java's."""
    texts = ["Ab ab AB cd ab", "x é1 É1 _ 一二 𝒜 𝒜𝒜", "ab\ncd\tab", "", None, "a b c"]
    docs = spark.createDataFrame([(None if i == 2 else i, t) for i, t in enumerate(texts)], "id int, text string").repartition(2)
    tf = M.terms(docs, "id", "text")
    plan = tf._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("ArrowEvalPython") == 1
    want = {(0, "ab", 4), (0, "cd", 1), (0, "ab ab", 2), (0, "ab cd", 1), (0, "cd ab", 1), (1, "é1", 2), (1, "é1 é1", 1), (1, "一二", 1), (1, "一二 𝒜𝒜", 1), (1, "é1 一二", 1), (1, "𝒜𝒜", 1)}
    want |= {(None, "ab", 2), (None, "cd", 1), (None, "ab cd", 1), (None, "cd ab", 1)}
    assert {tuple(r) for r in tf.collect()} == want and tf.count() == len(want) and tf.dtypes[1:] == [("term", "string"), ("tf", "bigint")]
    some = ["ab", "ab cd", "𝒜𝒜", "zz"]
    assert {tuple(r) for r in M.terms(docs, "id", "text", some).collect()} == {r for r in want if r[1] in some}
    twice = M.terms(docs.unionByName(docs), "id", "text", some)
    assert {tuple(r) for r in twice.collect()} == {(i, t, 2 * n) for i, t, n in want if t in some}
    assert {tuple(r) for r in M.terms(docs.where("false"), "id", "text").collect()} == set()


def test_decision_blocks_hold_train_rows_of_one_fold(spark):
    """Test rows are not carried through the steps, and a fold's rows meet only the jobs that train on it."""
    x, q, fold = RNG.normal(size=(900, 3)), RNG.normal(size=(900, 2)), RNG.integers(-1, 3, 900)
    q[:5], q[5:9], fold[:9] = np.nan, [[1.0, 1.0], [0.0, 0.0], [np.nan, 1.0], [-1.0, 0.0]], 1
    df = spark.createDataFrame([([1.0, *map(float, a), *map(float, b)], int(f)) for a, b, f in zip(x, q, fold)], "z array<double>, fold int").repartition(3)
    blocks = D._blocks(df.unionByName(df.limit(1).selectExpr("z", "cast(null AS int) AS fold")), 4, (4, 5), 400)
    found = blocks.collect()
    assert all(len(set(f)) == 1 and f[0] >= 0 for _, _, f in found) and sum(len(f) for _, _, f in found) == (fold >= 0).sum()
    out, coef = np.array([0, 1, 2, -1]), RNG.normal(size=(4, 4, 2))
    coef[:, 0] = 0  # ties
    z, used = np.column_stack([np.ones(900), x]), (fold[:, None] >= 0) & (fold[:, None] != out[None, :])
    want = np.tensordot(z.T, D.pull(np.tensordot(z, coef, 1), q) * used[:, :, None], 1)
    assert sum(D._gradients(*b, out, coef) for b in found) == pytest.approx(want, abs=1e-9)
