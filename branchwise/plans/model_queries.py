"""Resampling, linear models, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from branchwise.functions.outcomes import ARM_A, ARM_B
from branchwise.operators import classes as C
from branchwise.operators import linear as L
from branchwise.operators import resample as R
from branchwise.operators import splits as P
from branchwise.operators import transfer as T
from branchwise.plans import study as Y
from branchwise.plans import views
from branchwise.plans.common import full_values, plain_values, tidy, tidy_sql, top_level
from branchwise.plans.views import table, with_views
from branchwise.session import stored

N_BOOT = 2000


# --------------------------------------------------------------- resampling


def row_bootstrap_tau(spark, sf):
    return tidy(R.row_bootstrap(plain_values(spark, sf), "checkpoint_id", "tau", ["arm"], N_BOOT, 0))


def paired_r2_bootstrap(spark, sf):
    """R2 of predicting an arm-B value by the arm-A draw, against the steps-only rule."""
    v = plain_values(spark, sf)
    b = v.where(F.col("arm") == ARM_B).select("checkpoint_id", F.col("value_continue").alias("y"))
    a = v.where(F.col("arm") == ARM_A).select(
        "checkpoint_id", (F.col("m_continue") * -0.01).alias("steps"), F.col("value_continue").alias("draw")
    )
    return tidy(R.r2_bootstrap(a.join(b, "checkpoint_id"), "checkpoint_id", "y", ["steps", "draw"], N_BOOT, 1))


def cluster_bootstrap_tau(spark, sf):
    v = full_values(spark, sf)
    return tidy(R.cluster_bootstrap(v, "task_id", "tau", ["arm"], N_BOOT, 0))


def rank_bootstrap(spark, sf):
    """Intervals of statistics that are not sums: the median advantage, and the AUROC of the arm-A advantage for a likely
    success in arm B."""
    p = stored(_pairs(spark, sf), "rank-rows")
    median = R.rank_bootstrap(p, "checkpoint_id", "y", None, N_BOOT, 2).withColumn("stat", F.lit("median"))
    auc = R.rank_bootstrap(p, "checkpoint_id", "p", "likely", N_BOOT, 2).withColumn("stat", F.lit("auroc"))
    return tidy(median.unionByName(auc))


METRICS = ["value_continue", "value_intervene", "tau", "p_success_continue", "p_success_intervene"]


def _cohorts(spark, sf):
    v = full_values(spark, sf).where(F.col("arm") == ARM_B)
    return stored(v.select("checkpoint_id", "cohort", "task_type", "task_id", "t", *METRICS), "cohorts")


def _drift(v):
    """(rows of the compared cohorts, reference, stratified differences of all metrics)."""
    v, ref = R.compared(v, "cohort")
    return v, ref, R.stratified_difference(v, "checkpoint_id", "cohort", "task_type", METRICS, ref, N_BOOT, 0)


def cohort_drift(spark, sf):
    """Raw and stratified differences of each compared cohort to the largest one, for five metrics."""
    v, ref, strat = _drift(_cohorts(spark, sf))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])
    means = v.select("cohort", F.explode(rows).alias("r")).groupBy("cohort", "r.metric").agg(F.avg("r.x").alias("m"))
    a = means.where(F.col("cohort") == F.lit(ref)).select("metric", F.col("m").alias("ref_mean"))
    b = means.where(F.col("cohort") != F.lit(ref)).select("metric", F.col("cohort").alias("other"), F.col("m").alias("other_mean"))
    raw = a.join(b, "metric").withColumn("raw_diff", F.col("ref_mean") - F.col("other_mean"))
    return tidy(strat.join(raw, ["other", "metric"]))


def cohort_verdict(spark, sf):
    """Per compared cohort: the reference, strata in common, how many metrics still differ after stratifying, and whether
    pooling the two is sound."""
    v, ref, strat = _drift(_cohorts(spark, sf))
    per = strat.groupBy("other").agg(F.count(F.lit(1)).alias("n_metrics"), F.count_if("differs").alias("n_differ"))
    j = R.shared_strata(v, "cohort", "task_type", ref).join(per, "other", "left").fillna(0, ["n_metrics", "n_differ"])
    return j.select("other", F.lit(ref).alias("reference"), "n_shared", "n_strata", "n_metrics", "n_differ", (F.col("n_differ") == 0).alias("poolable"))


def cohort_drift_by_game(spark, sf):
    """The stricter form: strata are games. Work is strata x replicates."""
    v, ref = R.compared(_cohorts(spark, sf), "cohort")
    return tidy(R.stratified_difference(v, "checkpoint_id", "cohort", "task_id", ["tau"], ref, N_BOOT, 0))


def cohort_sizes(spark, sf):
    return tidy(R.cohort_sizes(_cohorts(spark, sf), "cohort"))


def cohort_composition(spark, sf):
    v = _cohorts(spark, sf)
    mean_t = v.groupBy("cohort").agg(F.avg("t").alias("mean_t"))
    return tidy(R.composition(v, "cohort", "task_type").join(mean_t, "cohort"))


def sign_stability(spark, sf):
    """Held-out minus train mean of every value column over five group splits."""
    v = full_values(spark, sf).where(F.col("arm") == ARM_B).select("task_id", "value_continue", "value_intervene", "tau")
    h = P.grouped_holdout(views.checkpoints(spark, sf), "task_id", Y.SEEDS)
    cols = ["value_continue", "value_intervene", "tau"]
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in cols])
    long = v.join(h, "task_id").select("seed", "is_test", F.explode(rows).alias("r")).select("seed", "is_test", "r.*")
    per = long.groupBy("metric", "seed").agg(
        (F.avg(F.when(F.col("is_test"), F.col("x"))) - F.avg(F.when(~F.col("is_test"), F.col("x")))).alias("delta")
    )
    s = R.sign_stability(per, ["metric"], "delta")
    nulls = R.null_candidates(s, 0.005).select("metric", F.lit(True).alias("null_candidate"))
    return tidy(s.join(nulls, "metric", "left").withColumn("null_candidate", F.coalesce("null_candidate", F.lit(False))))


def size_matched_means(spark, sf):
    v = plain_values(spark, sf).where(F.col("arm") == ARM_B).select("checkpoint_id", "tau")
    return tidy(R.size_matched(v, "checkpoint_id", 300).groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.avg("tau").alias("tau_mean")))


# ------------------------------------------------------------------- models


def ridge_battery(spark, sf):
    """Held-out R2 of three values and every feature block on five splits by game and five by rollout, and what a block gains
    over the observables."""
    fits = L.fit_models(L.fold_grams(Y.scheme_rows(spark, sf).select("z", "folds")), Y.battery(), ["seed_ix"])
    name = F.split("model", r"\|")
    fits = stored(fits.select("seed_ix", name[0].alias("target"), name[1].alias("model"), "alpha", "n_train", "n_test", "var_test", "r2"), "battery")
    return tidy(_gained(fits, "r2", ["alpha", "n_train", "n_test", "var_test", "r2"]))


def class_battery(spark, sf):
    """The same for the two class targets: accuracy and macro F1 of logistic models with the penalty of each split."""
    rows = Y.scheme_rows(spark, sf)
    models = C.fit_all(rows, Y.feature_blocks(), Y.CLASSES)
    named = F.when(F.col("target") == "oracle_ix", "oracle_action").otherwise(F.col("target")).alias("target")
    k = C.chosen_scores(rows, list(Y.CLASSES), models)
    k = stored(k.select(F.col("split").alias("seed_ix"), named, "model", F.col("c").alias("inverse_penalty"), "n_test", "accuracy", "macro_f1"), "class-battery")
    return tidy(_gained(k, "macro_f1", ["inverse_penalty", "n_test", "accuracy", "macro_f1"]))


def _gained(scores, score, cols):
    """Scores by scheme and seed with their gain over the observables: one row per split, target and block."""
    base = scores.where("model = 'observables'").select("seed_ix", "target", F.col(score).alias("base"))
    out = scores.join(base, ["seed_ix", "target"])
    return out.select(*Y.scheme(F.col("seed_ix")), "target", "model", *cols, (F.col(score) - F.col("base")).alias("delta"))


def ridge_one_feature(spark, sf):
    """Ridge of the intervene value on the checkpoint price: one feature, all penalties, five folds."""
    rows = Y.base_rows(spark, sf)
    z = F.array(F.lit(1.0), F.element_at("obs", 6), F.col("qi"))
    rows = stored(rows.select("checkpoint_id", "task_id", z.alias("z")), "one")
    fold = P.row_holdout(rows.select("task_id").distinct(), "task_id", [0]).select(
        "task_id", F.array(F.when(F.col("is_test"), -1).otherwise((F.col("task_id") % 5).cast("int"))).alias("folds")
    )
    fits = L.fit_models(L.fold_grams(rows.join(fold, "task_id")), [L.Model("price", (1,), 2)], ["seed_ix"])
    return tidy(
        fits.select(
            "alpha",
            "n_train",
            "n_test",
            "r2",
            F.element_at("coef", 1).alias("intercept"),
            F.element_at("coef", 2).alias("slope"),
        )
    )


def standardised_features(spark, sf):
    """Population mean and sd of every vector entry, from one cross-product."""
    e = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    s = e.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    return tidy(s.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))))


def nested_gain(spark, sf):
    """Baseline with the continue value, then plus each layer: gain in R2 on tau (seeds as splits)."""
    rows = Y.study_rows(spark, sf)
    base = Y.OBS_IX + (Y.QC_IX,)
    models = [L.Model("base", base, Y.TAU_IX)]
    models += [L.Model(f"layer{i}", base + Y.LAYER_IX[i], Y.TAU_IX) for i in range(Y.LAYERS)]
    fits = L.fit_models(L.fold_grams(rows), models, ["seed_ix"])
    b = fits.where("model = 'base'").select("seed_ix", F.col("r2").alias("base_r2"))
    d = fits.where("model <> 'base'").join(b, "seed_ix").withColumn("delta", F.col("r2") - F.col("base_r2"))
    return tidy(R.sign_stability(d, ["model"], "delta"))


def residual_gain(spark, sf):
    """Vectors predicting what the baseline leaves: out-of-fold residuals on train."""
    rows = Y.study_rows(spark, sf)
    base = L.Model("base", Y.OBS_IX + (Y.QC_IX,), Y.TAU_IX)
    fits = stored(L.fit_models(L.fold_grams(rows), [base], ["seed_ix"], oof=True), "fits")
    seeded = L.with_predictions(L.seeded_rows(rows), fits, ["base"])
    seeded = L.appended(seeded.withColumn("resid", F.col("tau") - F.col("p_base")), ["resid"])
    target = Y.TAU_IX + 1
    models = [L.Model(f"layer{i}", Y.LAYER_IX[i], target) for i in range(Y.LAYERS)]
    out = L.fit_models(L.seeded_grams(seeded), models, ["seed_ix"])
    return tidy(out.select("seed_ix", "model", "alpha", "n_test", "var_test", "r2"))


def _banded(spark, sf):
    rows = Y.study_rows(spark, sf)
    return L.fold_grams(rows, ["s_continue"])


def band_models(spark, sf):
    """Separate fits inside each risk band; a band below the floors (40 / 25 / 10) has a null score."""
    models = [
        L.Model("observables", Y.OBS_IX, Y.TAU_IX),
        L.Model("obs_vectors", Y.OBS_IX + Y.VEC_IX, Y.TAU_IX),
    ]
    fits = L.fit_models(_banded(spark, sf), models, ["seed_ix", "s_continue"])
    ok = fits.withColumn("r2", F.expr("CASE WHEN n_train + n_test >= 40 AND n_train >= 25 AND n_test >= 10 THEN r2 END"))
    return tidy(ok.select("seed_ix", "s_continue", "model", "alpha", "n_train", "n_test", "var_test", "r2"))


def conflict_set_models(spark, sf):
    """The top risk band, cut out after splitting the full cohort; floors 100 / 40."""
    top = L.fold_grams(top_level(Y.study_rows(spark, sf)))
    models = [
        L.Model("observables", Y.OBS_IX, Y.QI_IX),
        L.Model("vectors", Y.VEC_IX, Y.QI_IX),
        L.Model("both", Y.OBS_IX + Y.VEC_IX, Y.QI_IX),
    ]
    fits = L.fit_models(top, models, ["seed_ix"]).withColumn("ok", F.expr("n_train >= 100 AND n_test >= 40"))
    b = fits.where("model = 'observables'").select("seed_ix", F.col("r2").alias("base"))
    d = fits.join(b, "seed_ix").withColumn("delta", F.when(F.col("ok"), F.col("r2") - F.col("base")))
    return tidy(R.sign_stability(d, ["model"], "delta"))


def layer_sweep(spark, sf):
    """Gain of every layer over the observables: both values and their difference, and the intervene value in the top band."""
    rows = Y.study_rows(spark, sf)
    targets = {"qc": Y.QC_IX, "qi": Y.QI_IX, "tau": Y.TAU_IX}

    def fits(part, curves):
        models = []
        for c, t in curves.items():
            models.append(L.Model(f"{c}|base", Y.OBS_IX, t))
            models += [L.Model(f"{c}|layer{i}", Y.OBS_IX + Y.LAYER_IX[i], t) for i in range(Y.LAYERS)]
        return L.fit_models(L.fold_grams(part), models, ["seed_ix"]).select("seed_ix", "model", F.when(~F.isnan("r2"), F.col("r2")).alias("r2"))

    out = fits(rows, targets).unionByName(fits(top_level(rows), {"qi_top": Y.QI_IX}))
    name = F.split("model", r"\|")
    out = stored(out.select("seed_ix", name[0].alias("curve"), name[1].alias("block"), "r2"), "layer-fits")
    b = out.where("block = 'base'").select("seed_ix", "curve", F.col("r2").alias("base"))
    d = out.where("block <> 'base'").join(b, ["seed_ix", "curve"]).withColumn("delta", F.col("r2") - F.col("base"))
    s = R.sign_stability(d, ["curve", "block"], "delta").withColumn("layer", F.regexp_extract("block", "([0-9]+)$", 1).cast("int"))
    return tidy(s.select("curve", "layer", "n_scored", "mean", "sd", "consistent"))


def layer_summary(spark, sf):
    return tidy(layer_report(layer_sweep(spark, sf), ["curve"]))


def layer_report(s, keys=(), gain: float = 0.02, slack: float = 0.005):
    """Best layer, first layer with a consistent gain, monotone rise, share consistent, per curve."""
    from pyspark.sql import Window

    # One row per curve and layer of the model.
    w = Window.partitionBy(*keys, F.lit(0)).orderBy("layer")
    nxt = s.withColumn("next", F.lead("mean").over(w))
    return nxt.groupBy(*keys).agg(
        F.max(F.struct("mean", (-F.col("layer")).alias("nl"))).alias("b"),
        F.min(F.when((F.col("mean") > gain) & F.col("consistent"), F.col("layer"))).alias("first_layer"),
        F.bool_and(F.col("next").isNull() | (F.col("next") >= F.col("mean") - slack)).alias("monotone"),
        F.avg(F.col("consistent").cast("double")).alias("share_consistent"),
    ).select(*keys, (-F.col("b.nl")).alias("best_layer"), F.col("b.mean").alias("best_gain"), "first_layer", "monotone", "share_consistent")


def _ceiling_rows(spark, sf, scheme):
    v = full_values(spark, sf).where(F.col("arm") == ARM_B)
    v = stored(v.select("task_id", "rollout_id", F.col("value_intervene").alias("y")), "ceiling")
    key = "task_id" if scheme == "closed" else "rollout_id"
    hold = P.row_holdout(v.select(key).distinct(), key, Y.SEEDS).select(
        key, F.col("seed").alias("seed_ix"), F.when(F.col("is_test"), -1).otherwise((F.col(key) % 5).cast("int")).alias("fold")
    )
    return v.join(hold, key)


def group_ceiling(spark, sf):
    """Game identity alone: open split (games shared) against closed split (must not help)."""
    a = L.group_ceiling(_ceiling_rows(spark, sf, "open"), "task_id", "y").withColumn("scheme", F.lit("open"))
    b = L.group_ceiling(_ceiling_rows(spark, sf, "closed"), "task_id", "y").withColumn("scheme", F.lit("closed"))
    return tidy(a.unionByName(b).withColumn("control_ok", (F.col("scheme") == "open") | (F.col("r2") <= 0.02)))


# ----------------------------------------------------------------- transfer


def _transfer(spark, sf):
    """(rows, scores, name of the largest cohort) of the transfer study: three values by observables alone and with a layer."""
    rows, name = T.sided(Y.study_rows(spark, sf).drop("folds"))
    rows = rows.join(top_level(rows).select("checkpoint_id").withColumn("top", F.lit(True)), "checkpoint_id", "left")
    rows = T.with_splits(rows.withColumn("top", F.coalesce("top", F.lit(False))), "task_id", Y.SEEDS, N_DRAWS, "checkpoint_id")
    blocks = {"observables": Y.OBS_IX} | {f"obs_layer{i}": Y.OBS_IX + Y.LAYER_IX[i] for i in range(Y.LAYERS)} | {"obs_all": Y.OBS_IX + Y.VEC_IX}
    models = [L.Model(f"{t}|{b}", f, ix) for t, ix in Y.VALUES.items() for b, f in blocks.items()]
    return rows, stored(T.study(rows, models, len(Y.SEEDS), N_DRAWS, "top"), "transfer"), name


N_DRAWS = 5


def _told(scores, name, cols):
    """Scores by direction, target and block; a score that could not be made is null."""
    direction = F.when(F.col("source") == 0, F.concat(F.lit(name), F.lit(" -> rest"))).otherwise(F.concat(F.lit("rest -> "), F.lit(name)))
    part = F.split("model", r"\|")
    kinds = dict(scores.dtypes)
    known = [F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in cols]
    return tidy(scores.select(direction.alias("direction"), part[0].alias("target"), part[1].alias("block"), *known))


def frozen_transfer(spark, sf):
    """A model of one cohort on the other, both ways: all its rows, its games that the source never saw, and its top band,
    against the source's own held-out games over five seeds; and the cosine of both sides' scaled coefficients."""
    _, scores, name = _transfer(spark, sf)
    cols = ["alpha", "n_source", "n_dest", "n_unseen", "n_band", "within_r2", "within_sd", "frozen_r2", "degradation", "unseen_r2", "band_r2", "cosine"]
    return _told(scores, name, cols)


def transfer_calibration(spark, sf):
    """Direction against calibration on games the source never saw: the frozen model, a refit on the other side's shared
    games, five frozen refits on as few rows, the calibration line, recalibration on the shared games, and RMSE,
    Pearson and Spearman."""
    rows, scores, name = _transfer(spark, sf)
    ranks = T.rank_correlations(rows, scores, {"qc": "qc", "qi": "qi", "tau": "tau"})
    cols = ["alpha", "n_source", "n_unseen", "n_refit", "within_r2", "unseen_r2", "refit_r2", "frozen_minus_refit", "rmse", "pearson", "spearman", "slope", "intercept"]
    cols += ["recalibrated_r2", "size_matched_r2", "size_matched_sd", "n_draws", "size_matched_minus_refit", "cosine_raw"]
    return _told(scores.join(ranks, ["source", "model"], "left"), name, cols)


def difference_of_models(spark, sf):
    """Value models subtracted equal the direct advantage model when penalties match."""
    rows = Y.study_rows(spark, sf)
    models = [L.Model(n, Y.OBS_IX, t) for n, t in (("qc", Y.QC_IX), ("qi", Y.QI_IX), ("tau", Y.TAU_IX))]
    fits = fixed_alpha(L.fold_grams(rows), models, 10.0)
    p = fits.groupBy("seed_ix").agg(F.map_from_entries(F.collect_list(F.struct("model", "coef"))).alias("c"))
    gap = F.zip_with(
        F.zip_with(p["c"]["qi"], p["c"]["qc"], lambda a, b: a - b), p["c"]["tau"], lambda d, t: F.abs(d - t)
    )
    return tidy(p.select("seed_ix", F.array_max(gap).alias("max_gap")))


def fixed_alpha(grams, models, alpha):
    """Fits with one pinned penalty per model."""
    import pandas as pd

    def solve(key, pdf):
        folds, _ = L._matrices(pdf)
        return pd.DataFrame([(*key, m.name, L.fit(folds, m, alpha)[0]) for m in models], columns=["seed_ix", "model", "coef"])

    return grams.groupBy("seed_ix").applyInPandas(solve, "seed_ix int, model string, coef array<double>")


def oof_predictions(spark, sf):
    """Out-of-fold predictions on train and final predictions on test, scored per seed."""
    rows = Y.study_rows(spark, sf)
    m = L.Model("qc", Y.OBS_IX, Y.QC_IX)
    fits = L.fit_models(L.fold_grams(rows), [m], ["seed_ix"], oof=True)
    p = L.with_predictions(L.seeded_rows(rows), fits, ["qc"]).withColumn("part", F.when(F.col("fold") < 0, "test").otherwise("train"))
    return tidy(L.regression_metrics(p, ["seed_ix", "part"], "qc", "p_qc"))


# ------------------------------------------------------------------ metrics


def _pairs(spark, sf):
    v = plain_values(spark, sf)
    b = v.where(F.col("arm") == ARM_B).select("checkpoint_id", F.col("tau").alias("y"), "oracle_action", (F.col("p_success_continue") > 0.5).cast("int").alias("likely"))
    a = v.where(F.col("arm") == ARM_A).select("checkpoint_id", F.col("tau").alias("p"), F.col("oracle_action").alias("guess"))
    return a.join(b, "checkpoint_id").withColumn("grp", F.lit("all"))


def regression_metrics(spark, sf):
    return tidy(L.regression_metrics(_pairs(spark, sf), ["grp"], "y", "p"))


def rank_metrics(spark, sf):
    p = stored(_pairs(spark, sf), "pairs")
    return tidy(L.spearman(p, ["grp"], "y", "p").join(L.auroc(p, ["grp"], "likely", "p"), "grp"))


def class_metrics(spark, sf):
    return tidy(L.class_metrics(_pairs(spark, sf), ["grp"], "oracle_action", "guess"))


QUERIES = {
    f.__name__: f
    for f in (
        row_bootstrap_tau,
        paired_r2_bootstrap,
        cluster_bootstrap_tau,
        rank_bootstrap,
        cohort_drift,
        cohort_verdict,
        cohort_drift_by_game,
        cohort_sizes,
        cohort_composition,
        sign_stability,
        size_matched_means,
        ridge_battery,
        class_battery,
        ridge_one_feature,
        standardised_features,
        nested_gain,
        residual_gain,
        band_models,
        conflict_set_models,
        layer_sweep,
        layer_summary,
        group_ceiling,
        frozen_transfer,
        transfer_calibration,
        difference_of_models,
        oof_predictions,
        regression_metrics,
        rank_metrics,
        class_metrics,
    )
}

# ------------------------------------------------------------------ oracle


def boot_sql(rows: str, seed: int, n: int) -> str:
    """``bw``: (row columns, rep, wt) for a row source with a ``h`` column."""
    parts = ", ".join(
        f"('0x' || substr(md5('{seed}|' || rep), {1 + 8 * i}, 8))::BIGINT % {R.PRIME} AS c{i}" for i in range(4)
    )
    cuts = " + ".join(f"(v >= {t})::INT" for t in R.CUTS)
    p = R.PRIME
    return f"""
reps AS (SELECT rep::INT AS rep, {parts} FROM range(0, {n}) r(rep)),
bw AS (SELECT *, {cuts} AS wt FROM (
  SELECT b.*, rep, (((((c0 * h + c1) % {p}) * h + c2) % {p}) * h + c3) % {p} AS v FROM ({rows}) b, reps))"""


def h_sql(key: str) -> str:
    return f"('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT % {R.PRIME}"


_CI = "count(*) AS n_reps, round(avg(s), 6) + 0e0 AS boot_mean, round(quantile_cont(s, 0.025), 6) + 0e0 AS lo, round(quantile_cont(s, 0.975), 6) + 0e0 AS hi"

_HOLD = """
hold AS (
  SELECT seed, task_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || task_id)) <= greatest(1, round_even(3e-1 * count(*) OVER (PARTITION BY seed), 0)) AS is_test
  FROM (SELECT DISTINCT task_id FROM checkpoints), range(0, 5) s(seed))"""

_PAIRS = """
ab AS (
  SELECT b.checkpoint_id, b.tau AS y, b.oracle_action, (b.p_success_continue > 0.5)::INT AS likely, a.tau AS p, a.oracle_action AS guess, 'all' AS grp
  FROM vals a JOIN vals b USING (checkpoint_id) WHERE a.arm = 'A_replication' AND b.arm = 'B_montecarlo')"""


_COMPARED = """
cmp AS (SELECT * FROM cpvals WHERE arm = 'B_montecarlo' QUALIFY count(*) OVER (PARTITION BY cohort) >= 25),
ref AS (SELECT cohort FROM cmp GROUP BY cohort ORDER BY count(*) DESC, cohort LIMIT 1),"""


def _strat_sql(stratum: str, metrics: list[str], n: int) -> str:
    cols = ", ".join(metrics)
    sums = ", ".join(f"sum(wt * {m}) AS {m}" for m in metrics)
    rows = boot_sql(f"SELECT cohort, {stratum} AS st, {cols}, {h_sql('checkpoint_id')} AS h FROM cmp", 0, n)
    per = " UNION ALL ".join(
        f"SELECT b.cohort AS other, '{m}' AS metric, rep, sum((a.w + b.w) * (a.{m} / a.w - b.{m} / b.w)) / sum(a.w + b.w) AS s "
        f"FROM ss a JOIN ss b USING (st, rep) WHERE a.cohort = (FROM ref) AND b.cohort <> (FROM ref) AND a.w >= 2 AND b.w >= 2 GROUP BY ALL"
        for m in metrics
    )
    return _COMPARED + rows + f""",
ss AS (SELECT cohort, st, rep, sum(wt)::DOUBLE AS w, {sums} FROM bw GROUP BY ALL),
dd AS ({per}),
ci AS (SELECT other, metric, {_CI}, quantile_cont(s, 0.025) > 0 OR quantile_cont(s, 0.975) < 0 AS differs FROM dd GROUP BY ALL)"""


_RIDGE1 = f"""
rows1 AS (
  SELECT price / 1e3 AS x, value_intervene AS y,
    CASE WHEN ('0x' || substr(md5('0|' || task_id), 1, 8))::BIGINT / 4294967296e0 < 3e-1 THEN -1 ELSE task_id % 5 END AS fold
  FROM cpvals WHERE arm = 'B_montecarlo'),
al AS (SELECT unnest([1e0, 1e1, 1e2, 1e3, 1e4, 1e5, 1e6]) AS alpha),
sc AS (SELECT stddev_pop(x) AS sd FROM rows1 WHERE fold >= 0),
tr AS (SELECT h, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy
  FROM rows1, range(-1, 5) r(h) WHERE fold >= 0 AND fold <> h GROUP BY h),
fit AS (SELECT h, alpha, t.n, sxy / sd / (sxx / sd / sd + alpha) / sd AS b, my - sxy / sd / (sxx / sd / sd + alpha) / sd * mx AS a FROM tr t, sc, al),
score AS (SELECT h, alpha, any_value(n) AS n_train, any_value(a) AS a, any_value(b) AS b, count(*) AS n_test,
  1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)) AS r2 FROM fit JOIN rows1 ON fold = h GROUP BY h, alpha),
best AS (SELECT alpha FROM (SELECT alpha, avg(r2) AS m FROM score WHERE h >= 0 GROUP BY alpha) ORDER BY m DESC, alpha LIMIT 1)"""


def _ceiling_sql(scheme: str, key: str) -> str:
    p = scheme
    return f"""
{p}r AS (
  SELECT seed AS seed_ix, task_id, value_intervene AS y,
    CASE WHEN ('0x' || substr(md5(seed || '|' || {key}), 1, 8))::BIGINT / 4294967296e0 < 3e-1 THEN -1 ELSE {key} % 5 END AS fold
  FROM cpvals, range(0, 5) s(seed) WHERE arm = 'B_montecarlo'),
{p}t AS (SELECT seed_ix, h, task_id, count(*) AS n, sum(y) AS sy FROM {p}r, range(-1, 5) q(h) WHERE fold >= 0 AND fold <> h GROUP BY ALL),
{p}s AS (SELECT seed_ix, task_id, count(*) / sum(count(*)) OVER (PARTITION BY seed_ix)::DOUBLE AS sh FROM {p}r WHERE fold >= 0 GROUP BY seed_ix, task_id),
{p}p AS (SELECT t.*, alpha, alpha * CASE WHEN sh * (1 - sh) > 0 THEN sh * (1 - sh) ELSE 1 END AS pen FROM {p}t t JOIN {p}s USING (seed_ix, task_id), (SELECT unnest([1e0, 1e1, 1e2, 1e3, 1e4, 1e5, 1e6]) AS alpha)),
{p}b AS (SELECT seed_ix, h, alpha, sum(n * pen / (n + pen) * sy / n) / sum(n * pen / (n + pen)) AS b0 FROM {p}p GROUP BY ALL),
{p}e AS (SELECT seed_ix, h, alpha, task_id, b0 + (sy - n * b0) / (n + pen) AS f FROM {p}p JOIN {p}b USING (seed_ix, h, alpha)),
{p}v AS (
  SELECT r.seed_ix, r.fold AS h, b.alpha, count(*) AS n, 1 - sum((y - coalesce(f, b0)) ** 2) / (var_pop(y) * count(*)) AS r2
  FROM {p}r r JOIN {p}b b ON b.seed_ix = r.seed_ix AND b.h = r.fold LEFT JOIN {p}e e ON e.seed_ix = r.seed_ix AND e.h = r.fold AND e.alpha = b.alpha AND e.task_id = r.task_id GROUP BY ALL),
{p}k AS (SELECT seed_ix, alpha FROM (SELECT seed_ix, alpha, avg(r2) AS m FROM {p}v WHERE h >= 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY seed_ix ORDER BY m DESC, alpha) = 1)"""


ORACLE = {
    "row_bootstrap_tau": with_views(
        "vals",
        f"SELECT arm, {_CI} FROM (SELECT arm, rep, sum(wt * tau) / sum(wt) AS s FROM bw GROUP BY ALL) GROUP BY arm",
        boot_sql(f"SELECT arm, tau, {h_sql('checkpoint_id')} AS h FROM vals", 0, N_BOOT),
    ),
    "paired_r2_bootstrap": with_views(
        "vals",
        f"""SELECT stat, {_CI} FROM (SELECT rep, unnest(['r2_steps', 'r2_draw', 'delta_draw']) AS stat, unnest([r1, r2, r2 - r1]) AS s FROM (
          SELECT rep, 1 - sum(wt * (y - steps) ** 2) / (sum(wt * y * y) - sum(wt * y) ** 2 / sum(wt)) AS r1,
            1 - sum(wt * (y - draw) ** 2) / (sum(wt * y * y) - sum(wt * y) ** 2 / sum(wt)) AS r2 FROM bw GROUP BY rep)) GROUP BY stat""",
        boot_sql(
            f"SELECT b.value_continue AS y, a.m_continue * -1e-2 AS steps, a.value_continue AS draw, {h_sql('checkpoint_id')} AS h "
            "FROM vals a JOIN vals b USING (checkpoint_id) WHERE a.arm = 'A_replication' AND b.arm = 'B_montecarlo'",
            1,
            N_BOOT,
        ),
    ),
    "rank_bootstrap": with_views(
        "vals",
        f"""SELECT stat, {_CI} FROM (
          SELECT 'median' AS stat, rep, min(y) FILTER (2 * upto >= total) AS s FROM (
            SELECT rep, y, sum(wt) OVER (PARTITION BY rep ORDER BY y) AS upto, sum(wt) OVER (PARTITION BY rep) AS total FROM bw) GROUP BY rep
          UNION ALL
          SELECT 'auroc', rep, sum(wp * (upto - same / 2e0)) / (sum(wp) * sum(wn)) FROM (
            SELECT rep, wt * likely AS wp, wt * (1 - likely) AS wn, sum(wt * (1 - likely)) OVER (PARTITION BY rep ORDER BY p) AS upto,
              sum(wt * (1 - likely)) OVER (PARTITION BY rep, p) AS same FROM bw) GROUP BY rep) GROUP BY stat""",
        _PAIRS + "," + boot_sql(f"SELECT y, p, likely, {h_sql('checkpoint_id')} AS h FROM ab", 2, N_BOOT),
    ),
    "cluster_bootstrap_tau": with_views(
        "cpvals",
        f"SELECT arm, {_CI} FROM (SELECT arm, rep, sum(wt * s0) / sum(wt * m) AS s FROM bw GROUP BY ALL) GROUP BY arm",
        boot_sql(f"SELECT arm, task_id, count(*) AS m, sum(tau) AS s0, {h_sql('task_id')} AS h FROM cpvals GROUP BY arm, task_id", 0, N_BOOT),
    ),
    "cohort_drift": with_views(
        "cpvals",
        "SELECT ci.*, round(ref_mean, 6) + 0e0 AS ref_mean, round(other_mean, 6) + 0e0 AS other_mean, round(ref_mean - other_mean, 6) + 0e0 AS raw_diff FROM ci JOIN ("
        + " UNION ALL ".join(
            f"SELECT cohort AS other, '{m}' AS metric, (SELECT avg({m}) FROM cmp WHERE cohort = (FROM ref)) AS ref_mean, avg({m}) AS other_mean FROM cmp WHERE cohort <> (FROM ref) GROUP BY cohort"
            for m in METRICS
        )
        + ") USING (other, metric)",
        _strat_sql("task_type", METRICS, N_BOOT),
    ),
    "cohort_verdict": with_views(
        "cpvals",
        """SELECT o.other, (FROM ref) AS reference, o.n_shared, o.n_strata, coalesce(c.k, 0) AS n_metrics, coalesce(c.d, 0) AS n_differ, coalesce(c.d, 0) = 0 AS poolable
        FROM (SELECT cohort AS other, count(DISTINCT task_type) FILTER (task_type IN (SELECT task_type FROM cmp WHERE cohort = (FROM ref))) AS n_shared,
            (SELECT count(DISTINCT task_type) FROM cmp x WHERE x.cohort IN (cmp.cohort, (FROM ref))) AS n_strata
          FROM cmp WHERE cohort <> (FROM ref) GROUP BY cohort) o
        LEFT JOIN (SELECT other, count(*) AS k, count(*) FILTER (differs) AS d FROM ci GROUP BY other) c USING (other)""",
        _strat_sql("task_type", METRICS, N_BOOT),
    ),
    "cohort_drift_by_game": with_views("cpvals", "SELECT * FROM ci", _strat_sql("task_id", ["tau"], N_BOOT)),
    "cohort_sizes": with_views(
        "cpvals",
        """SELECT cohort, count(*) AS n, count(*) >= 25 AS compared, row_number() OVER (ORDER BY count(*) DESC, cohort) = 1 AS is_reference
        FROM cpvals WHERE arm = 'B_montecarlo' GROUP BY cohort""",
    ),
    "cohort_composition": with_views(
        "cpvals",
        """SELECT cohort, task_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cohort)::DOUBLE, 6) + 0e0 AS share,
        round(sum(sum(t)) OVER (PARTITION BY cohort) / sum(count(*)) OVER (PARTITION BY cohort)::DOUBLE, 6) + 0e0 AS mean_t FROM cpvals WHERE arm = 'B_montecarlo' GROUP BY cohort, task_type""",
    ),
    "sign_stability": with_views(
        "cpvals",
        """SELECT metric, count(*) AS n_splits, count(d) AS n_scored, round(avg(d), 6) + 0e0 AS mean, round(coalesce(stddev_samp(d), 0e0), 6) + 0e0 AS sd,
        bool_and(d > 0) OR bool_and(d < 0) AS consistent, NOT (bool_and(d > 0) OR bool_and(d < 0)) OR abs(avg(d)) < 5e-3 AS null_candidate FROM ("""
        + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, seed, avg({m}) FILTER (is_test) - avg({m}) FILTER (NOT is_test) AS d FROM cpvals JOIN hold USING (task_id) WHERE arm = 'B_montecarlo' GROUP BY seed"
            for m in ("value_continue", "value_intervene", "tau")
        )
        + ") GROUP BY metric",
        _HOLD,
    ),
    "size_matched_means": with_views(
        "vals",
        """SELECT draw::BIGINT AS draw, count(*) AS n, round(avg(tau), 6) + 0e0 AS tau_mean FROM (
          SELECT draw, tau FROM vals, range(0, 5) d(draw) WHERE arm = 'B_montecarlo'
          QUALIFY row_number() OVER (PARTITION BY draw ORDER BY md5(draw || '|' || checkpoint_id), checkpoint_id) <= 300) GROUP BY draw""",
    ),
    "ridge_one_feature": with_views(
        "cpvals",
        tidy_sql(
            "SELECT alpha, n_train, n_test, r2, a AS intercept, b AS slope FROM score WHERE h = -1 AND alpha = (SELECT alpha FROM best)",
            "r2 intercept slope",
        ),
        _RIDGE1,
    ),
    "standardised_features": """SELECT (i - 1)::BIGINT AS i, round(avg(x), 6) + 0e0 AS mean, round(CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1e0 END, 6) + 0e0 AS sd
      FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY i""",
    "group_ceiling": with_views(
        "cpvals",
        " UNION ALL ".join(
            f"SELECT seed_ix::BIGINT AS seed_ix, alpha, n, round(r2, 6) + 0e0 AS r2, '{s}' AS scheme, '{s}' = 'open' OR r2 <= 2e-2 AS control_ok FROM {s}v JOIN {s}k USING (seed_ix, alpha) WHERE h = -1"
            for s in ("open", "closed")
        ),
        _ceiling_sql("open", "rollout_id") + "," + _ceiling_sql("closed", "task_id"),
    ),
    "regression_metrics": with_views(
        "vals",
        tidy_sql(
            """SELECT grp, count(*) AS n, var_pop(y) AS target_var, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - p) ** 2)) AS rmse,
            corr(y, p) AS pearson, regr_slope(y, p) AS slope, regr_intercept(y, p) AS intercept FROM ab GROUP BY grp""",
            "target_var r2 rmse pearson slope intercept",
        ),
        _PAIRS,
    ),
    "rank_metrics": with_views(
        "vals",
        tidy_sql(
            """SELECT grp, corr(ra, rb) AS spearman, (sum(rb) FILTER (likely = 1) - n1 * (n1 + 1) / 2e0) / (n1 * n0) AS auroc FROM (
              SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS ra, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS rb,
                count(*) FILTER (likely = 1) OVER () AS n1, count(*) FILTER (likely = 0) OVER () AS n0 FROM ab) GROUP BY grp, n1, n0""",
            "spearman auroc",
        ),
        _PAIRS,
    ),
    "class_metrics": with_views(
        "vals",
        tidy_sql(
            """SELECT 'all' AS grp, (SELECT count(*) FROM ab) AS n, (SELECT avg((oracle_action = guess)::INT) FROM ab) AS accuracy, avg(f1) AS macro_f1 FROM (
              SELECT c, 2e0 * count(*) FILTER (oracle_action = c AND guess = c) / (count(*) FILTER (oracle_action = c) + count(*) FILTER (guess = c)) AS f1
              FROM ab, (SELECT oracle_action AS c FROM ab UNION SELECT guess FROM ab) GROUP BY c)""",
            "accuracy macro_f1",
        ),
        _PAIRS,
    ),
}
