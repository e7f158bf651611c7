"""Values, census, bands, sweep and descriptive reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from branchwise.functions import outcomes as O
from branchwise.operators import bins as B
from branchwise.operators import summaries as S
from branchwise.operators import values as V
from branchwise.plans import views
from branchwise.plans.common import full_values, groups, plain_values, stored_values, tidy, tidy_sql
from branchwise.plans.views import with_views

ACTS = O.ACTIONS


def _attempts(spark, sf):
    return V.attempt_stats(views.branches(spark, sf))


def _census(spark, sf):
    return V.census(V.select_attempts(_attempts(spark, sf)), views.N_REPLICATES)


def _bands(spark, sf):
    return B.band_stats(plain_values(spark, sf), ["arm"])


def realized_utility(spark, sf):
    b = views.branches(spark, sf)
    u = O.realized_utility(F.col("action"), F.col("success"), F.col("n_steps_in_branch"), O.DEFAULT.columns())
    return tidy(b.select("arm", "src", "branch_id", u.alias("utility")))


def value_row(spark, sf):
    v = plain_values(spark, sf)
    cols = [
        "checkpoint_id",
        "arm",
        "utility_params",
        "tau",
        "tau_se",
        "oracle_action",
        "oracle_value",
        "p_fail_continue",
    ]
    cols += [f"{m}_{a}" for a in ("continue", "intervene") for m in ("value", "se", "n", "p_success", "mean_steps")]
    return tidy(v.select(*cols))


def action_values(spark, sf):
    return tidy(V.long_values(plain_values(spark, sf)))


def regret_by_action(spark, sf):
    v = plain_values(spark, sf)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("action"),
                O.regret_of(F.lit(a), F.col("value_continue"), F.col("value_intervene")).alias("regret"),
            )
            for a in ACTS
        ]
    )
    e = v.select("arm", F.explode(rows).alias("r")).select("arm", "r.*")
    return tidy(e.groupBy("arm", "action").agg(F.avg("regret").alias("mean_regret"), F.max("regret").alias("max_regret")))


def completeness_census(spark, sf):
    c = _census(spark, sf)
    return tidy(c.select("checkpoint_id", "arm", "n_continue", "n_intervene", "n_quit", "verified", "complete", "reason"))


def census_reasons(spark, sf):
    return tidy(_census(spark, sf).groupBy("arm", "cohort", "reason").agg(F.count(F.lit(1)).alias("n")))


def usable_checkpoints(spark, sf):
    return V.usable_checkpoints(views.branches(spark, sf))


def abstraction_loss(spark, sf):
    return tidy(B.abstraction_loss(_bands(spark, sf), ["arm"]))


def conflict_by_band(spark, sf):
    d = B.conflict_detail(_bands(spark, sf))
    return tidy(d.select("arm", "bin", "n", "mixed", *[f"best_{a}" for a in ACTS]))


def tau_spread_by_band(spark, sf):
    return tidy(B.tau_spread(_bands(spark, sf)))


def _conf_values(spark, sf):
    """Values banded on a many-valued score: mean steps of the continue action."""
    v = plain_values(spark, sf).where(F.col("arm") == O.ARM_B)
    lv = v.groupBy("arm", F.col("m_continue").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("tau").alias("sum_tau"), F.count_if(F.col("tau") > 0).alias("n_positive")
    )
    return B.binned(lv, ["arm"], risk="score")


def quantile_bands(spark, sf):
    g = _conf_values(spark, sf).groupBy("arm", "bin")
    return tidy(
        g.agg(
            F.sum("n").alias("n"),
            (F.sum("sum_tau") / F.sum("n")).alias("tau_mean"),
            F.sum("n_positive").alias("n_positive"),
            F.min("score").alias("score_min"),
            F.max("score").alias("score_max"),
        )
    )


def bin_purity(spark, sf):
    return tidy(B.bin_purity(plain_values(spark, sf), ["arm"]))


def cost_sweep(spark, sf):
    cells = V.swept_cells(groups(spark, sf))
    bands = B.band_stats(cells, ["arm", "params"], F.col("weight"))
    return tidy(B.abstraction_loss(bands, ["arm", "params"]))


def action_margin_deciles(spark, sf):
    from branchwise.functions.ordered import exact_quantiles

    v = stored_values(spark, sf).withColumn("margin", O.action_margin(F.col("value_continue"), F.col("value_intervene")))
    return tidy(exact_quantiles(v, ["arm"], "margin", [i / 10 for i in range(1, 10)]))


def margin_decile_table(spark, sf):
    from branchwise.operators.policies import with_deciles

    v = stored_values(spark, sf).withColumn("margin", O.action_margin(F.col("value_continue"), F.col("value_intervene")))
    d = with_deciles(v, ["arm"], "margin")
    return tidy(
        d.groupBy("arm", "decile").agg(F.count(F.lit(1)).alias("n"), F.avg("margin").alias("mean"), F.avg("tau").alias("tau"))
    )


def progress_quartiles(spark, sf):
    v = full_values(spark, sf).withColumn("quartile", O.progress_quartile(F.col("progress")))
    return tidy(v.groupBy("arm", "quartile").agg(F.count(F.lit(1)).alias("n"), F.avg("tau").alias("tau_mean")))


def pinned_band_rows(spark, sf):
    v = stored_values(spark, sf)
    top, pin = B.top_band(v, ["arm"]), B.pinned_band(v, ["arm"], 1.0)
    a = top.groupBy("arm").agg(F.count(F.lit(1)).alias("n_top"), F.max("p_fail_continue").alias("top_level"))
    b = pin.groupBy("arm").agg(F.count(F.lit(1)).alias("n_pinned"), F.max("p_fail_continue").alias("pinned_level"))
    return tidy(a.join(b, "arm"))


def summary(spark, sf):
    return tidy(S.summary(stored_values(spark, sf)))


def tau_by_task_type(spark, sf):
    return tidy(S.tau_by_task_type(full_values(spark, sf)))


def rollout_summary(spark, sf):
    return tidy(S.rollout_summary(views.rollouts(spark, sf).join(views.tasks(spark, sf), "task_id"), ["task_type"]))


def terminal_reasons(spark, sf):
    return tidy(S.terminal_reasons(views.rollouts(spark, sf), []))


def branch_summary(spark, sf):
    return tidy(S.branch_summary(views.branches(spark, sf)))


def outcome_variation(spark, sf):
    return tidy(S.outcome_variation(views.rollouts(spark, sf)))


def outcome_variation_shares(spark, sf):
    return tidy(S.variation_shares(S.outcome_variation(views.rollouts(spark, sf))))


def outcome_sequences(spark, sf):
    return tidy(S.outcome_sequences(views.rollouts(spark, sf)))


def shortest_rollout(spark, sf):
    return tidy(S.shortest(views.rollouts(spark, sf).join(views.tasks(spark, sf), "task_id"), ["task_type"]))


def within_group_variance(spark, sf):
    return tidy(S.within_group_variance(full_values(spark, sf)))


def single_draw_flips(spark, sf):
    b = views.branches(spark, sf)
    return tidy(V.flip_rate(b, groups(spark, sf), O.ARM_B))


def success_histogram(spark, sf):
    return tidy(S.success_histogram(plain_values(spark, sf)))


def spread_table(spark, sf):
    return tidy(
        S.spread_table(plain_values(spark, sf), ["value_continue", "value_intervene", "tau", "p_success_intervene"])
    )


def step_distribution(spark, sf):
    return tidy(S.step_distribution(views.checkpoints(spark, sf)))


def binary_targets(spark, sf):
    v = plain_values(spark, sf)
    t = v.select(
        "arm",
        (F.col("p_success_continue") > 0.5).cast("int").alias("likely"),
        O.action_index(F.col("oracle_action")).alias("target"),
    )
    return tidy(t.groupBy("arm", "likely", "target").agg(F.count(F.lit(1)).alias("n")))


def budget_and_bucket(spark, sf):
    c = views.checkpoints(spark, sf).join(views.rollouts(spark, sf).select("rollout_id", "n_steps"), "rollout_id", "left")
    return tidy(
        c.select(
            "checkpoint_id",
            O.progress(F.col("t"), F.col("n_steps")).alias("progress"),
            O.remaining_budget(F.lit(50), F.col("t")).alias("remaining"),
            O.step_bucket(F.col("n_steps")).alias("bucket"),
        )
    )


def spo_plus_loss(spark, sf):
    """Loss of predicting each checkpoint's value by its arm-A draw."""
    v = plain_values(spark, sf)
    b = v.where(F.col("arm") == O.ARM_B).select("checkpoint_id", F.col("value_continue").alias("qc"), F.col("value_intervene").alias("qi"))
    a = v.where(F.col("arm") == O.ARM_A).select("checkpoint_id", F.col("value_continue").alias("hc"), F.col("value_intervene").alias("hi"))
    j = a.join(b, "checkpoint_id")
    gc, gi = O.spo_plus_subgradient(F.col("hc"), F.col("hi"), F.col("qc"), F.col("qi"))
    return tidy(
        j.select(
            "checkpoint_id",
            O.spo_plus_loss(F.col("hc"), F.col("hi"), F.col("qc"), F.col("qi")).alias("loss"),
            gc.alias("g_continue"),
            gi.alias("g_intervene"),
            O.regret_of(O.best_action(F.col("hc"), F.col("hi")), F.col("qc"), F.col("qi")).alias("regret"),
        )
    )


QUERIES = {
    f.__name__: f
    for f in (
        realized_utility,
        value_row,
        action_values,
        regret_by_action,
        completeness_census,
        census_reasons,
        usable_checkpoints,
        abstraction_loss,
        conflict_by_band,
        tau_spread_by_band,
        quantile_bands,
        bin_purity,
        cost_sweep,
        action_margin_deciles,
        margin_decile_table,
        progress_quartiles,
        pinned_band_rows,
        summary,
        tau_by_task_type,
        rollout_summary,
        terminal_reasons,
        branch_summary,
        outcome_variation,
        outcome_variation_shares,
        outcome_sequences,
        shortest_rollout,
        within_group_variance,
        single_draw_flips,
        success_histogram,
        spread_table,
        step_distribution,
        binary_targets,
        budget_and_bucket,
        spo_plus_loss,
    )
}

_BANDS = """
levels AS (
  SELECT arm, s_continue, n_continue, 1e0 - s_continue::DOUBLE / n_continue AS risk, count(*) AS n, sum(value_continue) AS sc,
    sum(value_intervene) AS si, sum(oracle_value) AS sb, sum(tau) AS st, min(tau) AS lo, max(tau) AS hi,
    count(*) FILTER (oracle_action = 'continue') AS best_continue, count(*) FILTER (oracle_action = 'intervene') AS best_intervene,
    count(*) FILTER (oracle_action = 'quit') AS best_quit
  FROM vals GROUP BY arm, s_continue, n_continue),
bands AS (SELECT *, dense_rank() OVER (PARTITION BY arm ORDER BY risk) - 1 AS bin FROM levels)"""

_SWEEP = """
grid AS (
  SELECT c, w, 'c' || printf('%.2f', c) || '_w' || printf('%.2f', w) AS params
  FROM (VALUES (0e0), (5e-2), (1e-1), (15e-2), (2e-1)) a(c), (VALUES (0e0), (5e-1), (1e0), (15e-1), (2e0)) b(w)),
sv AS (
  SELECT arm, params, s_continue,
    (s_continue * (1e0 + w) - w * n_continue - 0e0 * n_continue - 1e-2 * m_continue) / n_continue AS vc,
    (s_intervene * (1e0 + w) - w * n_intervene - c * n_intervene - 1e-2 * m_intervene) / n_intervene AS vi
  FROM ok, grid),
so AS (
  SELECT *, CASE WHEN vc >= vi AND vc >= 0 THEN 'continue' WHEN vi >= 0 THEN 'intervene' ELSE 'quit' END AS best,
    greatest(vc, vi, 0e0) AS vb FROM sv),
sb AS (
  SELECT arm, params, s_continue, count(*) AS n, sum(vb) AS vb, greatest(sum(vc), sum(vi), 0e0) AS vp,
    count(DISTINCT best) AS kinds, count(*) FILTER (best = 'intervene') AS ni FROM so GROUP BY ALL)"""

_DECILES = """
m AS (
  SELECT arm, tau, list_sort([value_continue, value_intervene, 0e0]) AS r, r[3] - r[2] AS margin FROM vals),
e AS (SELECT arm, quantile_cont(margin, [.1, .2, .3, .4, .5, .6, .7, .8, .9]) AS q,
  list_transform(quantile_cont(round(margin * 1e9), [.1, .2, .3, .4, .5, .6, .7, .8, .9]), lambda x: round(x * 20)::BIGINT) AS u FROM m GROUP BY arm)"""

ORACLE = {
    "realized_utility": with_views(
        "branches",
        tidy_sql(
            """SELECT arm, src, branch_id, CASE WHEN action = 'quit' THEN 0e0 ELSE (CASE WHEN success THEN 1e0 ELSE -1e0 END)
            - (CASE WHEN action = 'intervene' THEN 5e-2 ELSE 0e0 END) - 1e-2 * n_steps_in_branch END AS utility FROM branches""",
            "utility",
        ),
    ),
    "value_row": with_views(
        "vals",
        tidy_sql(
            """SELECT checkpoint_id, arm, 'default' AS utility_params, tau, tau_se, oracle_action, oracle_value, p_fail_continue,
            value_continue, se_continue, n_continue, p_success_continue, mean_steps_continue,
            value_intervene, se_intervene, n_intervene, p_success_intervene, mean_steps_intervene FROM vals""",
            "tau tau_se oracle_value p_fail_continue value_continue se_continue p_success_continue mean_steps_continue "
            "value_intervene se_intervene p_success_intervene mean_steps_intervene",
            "n_continue n_intervene",
        ),
    ),
    "action_values": with_views(
        "vals",
        tidy_sql(
            """SELECT checkpoint_id, arm, 'continue' AS action, n_continue AS n, value_continue AS value, se_continue AS se,
              p_success_continue AS p_success, mean_steps_continue AS mean_steps FROM vals
            UNION ALL SELECT checkpoint_id, arm, 'intervene', n_intervene, value_intervene, se_intervene, p_success_intervene, mean_steps_intervene FROM vals
            UNION ALL SELECT checkpoint_id, arm, 'quit', 1, 0e0, 0e0, 0e0, 0e0 FROM vals""",
            "value se p_success mean_steps",
            "n",
        ),
    ),
    "regret_by_action": with_views(
        "vals",
        tidy_sql(
            """SELECT arm, action, avg(oracle_value - v) AS mean_regret, max(oracle_value - v) AS max_regret FROM (
              SELECT arm, oracle_value, 'continue' AS action, value_continue AS v FROM vals
              UNION ALL SELECT arm, oracle_value, 'intervene', value_intervene FROM vals
              UNION ALL SELECT arm, oracle_value, 'quit', 0e0 FROM vals) GROUP BY ALL""",
            "mean_regret max_regret",
        ),
    ),
    "completeness_census": with_views(
        "vals",
        """SELECT checkpoint_id, arm, n_continue::BIGINT AS n_continue, n_intervene::BIGINT AS n_intervene, n_quit::BIGINT AS n_quit,
        n_unverified = 0 AS verified, reason = 'ok' AS complete, reason FROM census""",
    ),
    "census_reasons": with_views("vals", "SELECT arm, cohort, reason, count(*) AS n FROM census GROUP BY ALL"),
    "usable_checkpoints": with_views(
        "branches", "SELECT checkpoint_id FROM branches GROUP BY checkpoint_id HAVING bool_and(replay_verified)"
    ),
    "abstraction_loss": with_views(
        "vals",
        tidy_sql(
            """SELECT arm, sum(n) AS n, sum(sb) / sum(n) AS oracle_value, (sum(sb) - sum(greatest(sc, si, 0e0))) / sum(n) AS gap,
            coalesce(sum(n) FILTER ((best_continue > 0)::INT + (best_intervene > 0)::INT + (best_quit > 0)::INT > 1), 0) / sum(n)::DOUBLE AS conflict_mass,
            sum(best_intervene) / sum(n)::DOUBLE AS intervene_share FROM bands GROUP BY arm""",
            "oracle_value gap conflict_mass intervene_share",
            "n",
        ),
        _BANDS,
    ),
    "conflict_by_band": with_views(
        "vals",
        """SELECT arm, bin::BIGINT AS bin, n::BIGINT AS n, (best_continue > 0)::INT + (best_intervene > 0)::INT + (best_quit > 0)::INT > 1 AS mixed,
        best_continue::BIGINT AS best_continue, best_intervene::BIGINT AS best_intervene, best_quit::BIGINT AS best_quit FROM bands""",
        _BANDS,
    ),
    "tau_spread_by_band": with_views(
        "vals",
        tidy_sql(
            """SELECT arm, dense_rank() OVER (PARTITION BY arm ORDER BY risk_mean) - 1 AS bin, * EXCLUDE (arm) FROM (
            SELECT arm, min(tau) AS min_tau, max(tau) AS max_tau, count(*) AS n,
            avg(1e0 - s_continue::DOUBLE / n_continue) AS risk_mean, avg(tau) AS tau_mean, stddev_samp(tau) AS tau_sd,
            min(tau) < 0 AND max(tau) > 0 AS straddles_zero FROM vals GROUP BY arm, s_continue, n_continue) WHERE n >= 2""",
            "min_tau max_tau risk_mean tau_mean tau_sd",
            "bin n",
        ),
    ),
    "quantile_bands": with_views(
        "vals",
        tidy_sql(
            """SELECT arm, len(list_filter(q, lambda x: x < m_continue)) AS bin, count(*) AS n, avg(tau) AS tau_mean,
            count(*) FILTER (tau > 0) AS n_positive, min(m_continue) AS score_min, max(m_continue) AS score_max
            FROM vals, (SELECT quantile_cont(m_continue::DOUBLE, [.1, .2, .3, .4, .5, .6, .7, .8, .9]) AS q FROM vals WHERE arm = 'B_montecarlo')
            WHERE arm = 'B_montecarlo' GROUP BY ALL""",
            "tau_mean",
            "bin n n_positive score_min score_max",
        ),
    ),
    "bin_purity": with_views(
        "vals",
        """SELECT arm, round(risk, 6) + 0e0 AS risk, n::BIGINT AS n, best_continue::BIGINT AS best_continue, best_intervene::BIGINT AS best_intervene,
        best_quit::BIGINT AS best_quit, CASE WHEN (best_continue > 0)::INT + (best_intervene > 0)::INT + (best_quit > 0)::INT > 1 THEN 'mixed' ELSE 'PURE' END AS purity FROM bands""",
        _BANDS,
    ),
    "cost_sweep": with_views(
        "vals",
        tidy_sql(
            """SELECT arm, params, sum(n) AS n, sum(vb) / sum(n) AS oracle_value, (sum(vb) - sum(vp)) / sum(n) AS gap,
            coalesce(sum(n) FILTER (kinds > 1), 0) / sum(n)::DOUBLE AS conflict_mass, sum(ni) / sum(n)::DOUBLE AS intervene_share
            FROM sb GROUP BY arm, params""",
            "oracle_value gap conflict_mass intervene_share",
            "n",
        ),
        _SWEEP,
    ),
    "action_margin_deciles": with_views(
        "vals",
        tidy_sql("SELECT arm, i / 1e1 AS prob, q[i] AS quantile FROM e, range(1, 10) r(i)", "prob quantile"),
        _DECILES,
    ),
    "margin_decile_table": with_views(
        "vals",
        tidy_sql(
            """SELECT arm, len(list_filter(u, lambda x: x < 20 * round(margin * 1e9)::BIGINT)) AS decile, count(*) AS n, avg(margin) AS mean, avg(tau) AS tau
            FROM m JOIN e USING (arm) GROUP BY ALL""",
            "mean tau",
            "decile n",
        ),
        _DECILES,
    ),
    "progress_quartiles": with_views(
        "cpvals",
        tidy_sql(
            "SELECT arm, least(4, floor(progress * 4)::INT + 1) AS quartile, count(*) AS n, avg(tau) AS tau_mean FROM cpvals GROUP BY ALL",
            "tau_mean",
            "quartile n",
        ),
    ),
    "pinned_band_rows": with_views(
        "vals",
        tidy_sql(
            """SELECT arm, count(*) FILTER (p = hi) AS n_top, max(hi) AS top_level, count(*) FILTER (p = near) AS n_pinned, max(near) AS pinned_level
            FROM (SELECT arm, p_fail_continue AS p, max(p_fail_continue) OVER (PARTITION BY arm) AS hi,
              first(p_fail_continue) OVER (PARTITION BY arm ORDER BY abs(p_fail_continue - 1e0), p_fail_continue) AS near FROM vals) GROUP BY arm""",
            "top_level pinned_level",
            "n_top n_pinned",
        ),
    ),
    "summary": with_views(
        "vals",
        tidy_sql(
            """SELECT arm, count(*) AS n, avg((oracle_action = 'continue')::INT) AS share_continue, avg((oracle_action = 'intervene')::INT) AS share_intervene,
            avg((oracle_action = 'quit')::INT) AS share_quit, avg(p_success_continue) AS success_continue, avg(value_continue) AS mean_value_continue,
            avg(p_success_intervene) AS success_intervene, avg(value_intervene) AS mean_value_intervene, avg(tau) AS tau_mean,
            coalesce(stddev_samp(tau), 0) AS tau_sd, min(tau) AS tau_min, max(tau) AS tau_max, avg((tau > 0)::INT) AS tau_positive,
            coalesce(stddev_samp(tau), 0) / greatest(1e-9, avg(tau_se)) AS spread_over_se,
            quantile_cont(tau_se, 0.5) AS tau_se_p50, quantile_cont(tau_se, 0.9) AS tau_se_p90 FROM vals GROUP BY arm""",
            "share_continue share_intervene share_quit success_continue mean_value_continue success_intervene mean_value_intervene "
            "tau_mean tau_sd tau_min tau_max tau_positive spread_over_se tau_se_p50 tau_se_p90",
            "n",
        ),
    ),
    "tau_by_task_type": with_views(
        "cpvals",
        tidy_sql("SELECT arm, task_type, count(*) AS n, avg(tau) AS tau_mean FROM cpvals GROUP BY ALL", "tau_mean", "n"),
    ),
    "rollout_summary": with_views(
        "rollouts tasks",
        tidy_sql(
            """SELECT task_type, count(*) AS n, avg(success::INT) AS success_rate, min(n_steps) AS steps_min, avg(n_steps) AS steps_mean,
            max(n_steps) AS steps_max FROM rollouts JOIN tasks USING (task_id) GROUP BY ALL""",
            "success_rate steps_mean",
            "n steps_min steps_max",
        ),
    ),
    "terminal_reasons": with_views("rollouts", "SELECT terminal_reason, count(*) AS n FROM rollouts GROUP BY ALL"),
    "branch_summary": with_views(
        "branches",
        tidy_sql(
            """SELECT arm, action, count(*) AS n, avg(replay_verified::INT) AS verified_rate,
            avg(success::INT) FILTER (replay_verified) AS success_rate FROM branches GROUP BY ALL""",
            "verified_rate success_rate",
            "n",
        ),
    ),
    "outcome_variation": with_views(
        "rollouts",
        tidy_sql(
            """SELECT task_id, count(*) AS n_rollouts, count(*) FILTER (success) AS n_success, min(n_steps) AS steps_min, max(n_steps) AS steps_max,
            count(DISTINCT success) > 1 AS outcome_varies, count(DISTINCT n_steps) > 1 AS steps_vary FROM rollouts GROUP BY task_id""",
            "",
            "n_rollouts n_success steps_min steps_max",
        ),
    ),
    "outcome_variation_shares": with_views(
        "rollouts",
        tidy_sql(
            """SELECT count(*) AS n_games, avg((a > 1)::INT) AS outcome_share, avg((b > 1)::INT) AS steps_share FROM (
            SELECT count(DISTINCT success) AS a, count(DISTINCT n_steps) AS b FROM rollouts GROUP BY task_id HAVING count(*) >= 2)""",
            "outcome_share steps_share",
            "n_games",
        ),
    ),
    "outcome_sequences": with_views(
        "rollouts",
        """SELECT task_id, (pos - 1) // 64 AS run, string_agg(success::INT::VARCHAR, ',' ORDER BY rollout_id) AS outcomes,
        string_agg(n_steps::VARCHAR, ',' ORDER BY rollout_id) AS lengths
        FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY rollout_id) AS pos FROM rollouts) GROUP BY ALL""",
    ),
    "shortest_rollout": with_views(
        "rollouts tasks",
        tidy_sql(
            """SELECT task_type, rollout_id, n_steps FROM rollouts JOIN tasks USING (task_id)
            QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY n_steps, rollout_id) = 1""",
            "",
            "rollout_id n_steps",
        ),
    ),
    "within_group_variance": with_views(
        "cpvals",
        tidy_sql(
            """SELECT arm, grouping, sum(n * v) / sum(n) AS within_var, sum(n * v) / sum(n) / any_value(total) AS retained FROM (
            SELECT arm, 'task_type' AS grouping, count(*) AS n, var_pop(tau) AS v FROM cpvals GROUP BY arm, task_type
            UNION ALL SELECT arm, 'step', count(*), var_pop(tau) FROM cpvals GROUP BY arm, t
            UNION ALL SELECT arm, 'type_x_bucket', count(*), var_pop(tau) FROM cpvals GROUP BY arm, task_type, t // 10)
            JOIN (SELECT arm, var_pop(tau) AS total FROM cpvals GROUP BY arm) USING (arm) GROUP BY arm, grouping""",
            "within_var retained",
        ),
    ),
    "single_draw_flips": with_views(
        "vals",
        tidy_sql(
            """SELECT *, flips / greatest(trials, 1)::DOUBLE AS flip_rate, n_varying / greatest(n_checkpoints, 1)::DOUBLE AS varying_share FROM (
            SELECT count(*) AS trials, count(*) FILTER (CASE WHEN value_continue >= one AND value_continue >= 0 THEN 'continue' WHEN one >= 0 THEN 'intervene' ELSE 'quit' END <> oracle_action) AS flips
            FROM (SELECT v.*, (d.packed // 2 % 2 * 2e0 - 1e0 - 5e-2 - 1e-2 * (d.packed // 4)) AS one
              FROM vals v JOIN dedup d USING (checkpoint_id, arm, src) WHERE arm = 'B_montecarlo' AND d.action = 'intervene' AND n_intervene >= 2)),
            (SELECT count(*) AS n_checkpoints, count(*) FILTER (s_intervene > 0 AND s_intervene < n_intervene) AS n_varying,
              avg(sqrt((n_intervene * s_intervene - s_intervene * s_intervene) / (n_intervene * (n_intervene - 1))::DOUBLE)) AS mean_success_sd
              FROM vals WHERE arm = 'B_montecarlo' AND n_intervene >= 2)""",
            "mean_success_sd flip_rate varying_share",
            "trials flips n_checkpoints n_varying",
        ),
    ),
    "success_histogram": with_views(
        "vals",
        "SELECT arm, round(p_success_intervene, 2) + 0e0 AS p_success, count(*) AS n FROM vals GROUP BY ALL",
    ),
    "spread_table": with_views(
        "vals",
        tidy_sql(
            " UNION ALL ".join(
                f"SELECT arm, '{c}' AS quantity, avg({c}) AS mean, coalesce(stddev_samp({c}), 0e0) AS sd, min({c}) AS min, max({c}) AS max FROM vals GROUP BY arm"
                for c in ("value_continue", "value_intervene", "tau", "p_success_intervene")
            ),
            "mean sd min max",
        ),
    ),
    "step_distribution": with_views("checkpoints", "SELECT t::BIGINT AS t, count(*) AS n FROM checkpoints GROUP BY ALL"),
    "binary_targets": with_views(
        "vals",
        """SELECT arm, (p_success_continue > 0.5)::BIGINT AS likely,
        (CASE oracle_action WHEN 'continue' THEN 0 WHEN 'intervene' THEN 1 ELSE 2 END)::BIGINT AS target, count(*) AS n FROM vals GROUP BY ALL""",
    ),
    "budget_and_bucket": with_views(
        "checkpoints rollouts",
        """SELECT checkpoint_id, round(t::DOUBLE / n_steps, 6) + 0e0 AS progress, greatest(0, 50 - t)::BIGINT AS remaining,
        (n_steps // 10)::BIGINT AS bucket FROM checkpoints LEFT JOIN rollouts USING (rollout_id)""",
    ),
    "spo_plus_loss": with_views(
        "vals",
        tidy_sql(
            """SELECT checkpoint_id, greatest(2 * hc - qc, 2 * hi - qi, 0e0) + greatest(qc, qi, 0e0) - 2 * (CASE star WHEN 0 THEN hc WHEN 1 THEN hi ELSE 0e0 END) AS loss,
            2e0 * (tilde = 0)::INT - 2e0 * (star = 0)::INT AS g_continue, 2e0 * (tilde = 1)::INT - 2e0 * (star = 1)::INT AS g_intervene,
            greatest(qc, qi, 0e0) - (CASE WHEN hc >= hi AND hc >= 0 THEN qc WHEN hi >= 0 THEN qi ELSE 0e0 END) AS regret
            FROM (SELECT *, CASE WHEN qc >= qi AND qc >= 0 THEN 0 WHEN qi >= 0 THEN 1 ELSE 2 END AS star,
              CASE WHEN 2 * hc - qc >= 2 * hi - qi AND 2 * hc - qc >= 0 THEN 0 WHEN 2 * hi - qi >= 0 THEN 1 ELSE 2 END AS tilde
              FROM (SELECT a.checkpoint_id, a.value_continue AS hc, a.value_intervene AS hi, b.value_continue AS qc, b.value_intervene AS qi
                FROM vals a JOIN vals b USING (checkpoint_id) WHERE a.arm = 'A_replication' AND b.arm = 'B_montecarlo'))""",
            "loss g_continue g_intervene regret",
        ),
    ),
}
