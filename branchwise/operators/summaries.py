"""Descriptive reports over values, rollouts and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchwise.functions.ordered import previous, quantile_columns
from branchwise.functions.outcomes import ACTIONS, nonzero, step_bucket


def sample_sd(x) -> Column:
    """Sample standard deviation, 0 for a single row."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def summary(values: DataFrame) -> DataFrame:
    """One row per arm: best-action mix, success, values, advantage, errors."""
    n = F.count(F.lit(1))
    aggs = [n.alias("n")]
    aggs += [(F.count_if(F.col("oracle_action") == a) / n).alias(f"share_{a}") for a in ACTIONS]
    for a in ("continue", "intervene"):
        aggs += [F.avg(f"p_success_{a}").alias(f"success_{a}"), F.avg(f"value_{a}").alias(f"mean_value_{a}")]
    aggs += [
        F.avg("tau").alias("tau_mean"),
        sample_sd("tau").alias("tau_sd"),
        F.min("tau").alias("tau_min"),
        F.max("tau").alias("tau_max"),
        (F.count_if(F.col("tau") > 0) / n).alias("tau_positive"),
        (sample_sd("tau") / F.greatest(F.lit(1e-9), F.avg("tau_se"))).alias("spread_over_se"),
    ]
    base = values.groupBy("arm").agg(*aggs)
    se = quantile_columns(values, ["arm"], "tau_se", {"tau_se_p50": 0.5, "tau_se_p90": 0.9})
    return base.join(se, "arm", "left")


def tau_by_task_type(values: DataFrame) -> DataFrame:
    return values.groupBy("arm", "task_type").agg(F.count(F.lit(1)).alias("n"), F.avg("tau").alias("tau_mean"))


def rollout_summary(rollouts: DataFrame, keys: list[str]) -> DataFrame:
    return rollouts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.min("n_steps").alias("steps_min"),
        F.avg("n_steps").alias("steps_mean"),
        F.max("n_steps").alias("steps_max"),
    )


def terminal_reasons(rollouts: DataFrame, keys: list[str]) -> DataFrame:
    return rollouts.groupBy(*keys, "terminal_reason").agg(F.count(F.lit(1)).alias("n"))


def branch_summary(branches: DataFrame) -> DataFrame:
    """Verified share and success per arm and action."""
    ok = F.coalesce("replay_verified", F.lit(False))
    return branches.groupBy("arm", "action").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(ok.cast("double")).alias("verified_rate"),
        F.avg(F.when(ok, F.col("success").cast("double"))).alias("success_rate"),
    )


def outcome_variation(rollouts: DataFrame) -> DataFrame:
    """Per game, whether repeated rollouts differ in outcome or length.

    Only distinct counts and extremes are kept per game, never the list of
    rollouts, so a game of any size is one small row.
    """
    return rollouts.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_rollouts"),
        F.count_if("success").alias("n_success"),
        F.min("n_steps").alias("steps_min"),
        F.max("n_steps").alias("steps_max"),
    ).select(
        "*",
        ((F.col("n_success") > 0) & (F.col("n_success") < F.col("n_rollouts"))).alias("outcome_varies"),
        (F.col("steps_min") < F.col("steps_max")).alias("steps_vary"),
    )


def variation_shares(per_game: DataFrame) -> DataFrame:
    many = per_game.where("n_rollouts >= 2")
    return many.agg(
        F.count(F.lit(1)).alias("n_games"),
        F.avg(F.col("outcome_varies").cast("double")).alias("outcome_share"),
        F.avg(F.col("steps_vary").cast("double")).alias("steps_share"),
    )


def outcome_sequences(rollouts: DataFrame, max_rollouts: int = 64) -> DataFrame:
    """Outcome and length lists per game in rollout order.

    Lists are cut into numbered runs of ``max_rollouts`` so a game of any size is
    printed whole without one growing array.
    """
    from branchwise.functions.ordered import numbered

    placed = numbered(rollouts, ["task_id"], F.floor(F.col("rollout_id") / 65536), ["rollout_id"], "pos")
    runs = placed.withColumn("run", F.floor((F.col("pos") - 1) / max_rollouts))
    packed = runs.groupBy("task_id", "run").agg(
        F.array_sort(F.collect_list(F.struct("rollout_id", F.col("success").cast("int").alias("won"), "n_steps"))).alias("r")
    )
    return packed.select(
        "task_id",
        "run",
        F.array_join(F.transform("r", lambda x: x["won"].cast("string")), ",").alias("outcomes"),
        F.array_join(F.transform("r", lambda x: x["n_steps"].cast("string")), ",").alias("lengths"),
    )


def with_offered(steps: DataFrame, keys: list[str], pos: str, commands: str, initial: Column) -> DataFrame:
    """Add the command set each action was chosen from: the state before the step."""
    lagged = previous(steps, keys, pos, [commands])
    return lagged.withColumn("offered", F.coalesce(F.col(f"prev_{commands}"), initial)).drop(f"prev_{commands}")


def step_rates(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Shares over steps; needs ``offered``, ``action``, ``obs`` and ``confidence``."""
    n = F.count(F.lit(1))
    return steps.groupBy(*keys).agg(
        n.alias("n_steps"),
        (F.count_if(F.array_contains("offered", F.col("action"))) / n).alias("admissible_rate"),
        (F.count_if(F.col("action") == "") / n).alias("empty_rate"),
        (F.count_if(F.lower("obs").contains("nothing happens")) / n).alias("nothing_happens_rate"),
        F.count("confidence").alias("n_confidence"),
        F.avg("confidence").alias("mean_confidence"),
    )


def top_actions(steps: DataFrame, k: int = 12) -> DataFrame:
    """Most frequent actions and whether any state ever offered them."""
    counts = steps.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    offered = steps.select(F.explode("offered").alias("action")).distinct().withColumn("ok", F.lit(True))
    top = counts.orderBy(F.col("n").desc(), "action").limit(k)
    return top.join(offered, "action", "left").select(
        "action", "n", F.coalesce("ok", F.lit(False)).alias("admissible_somewhere")
    )


def shortest(rollouts: DataFrame, keys: list[str]) -> DataFrame:
    return rollouts.groupBy(*keys).agg(F.min(F.struct("n_steps", "rollout_id")).alias("r")).select(
        *keys, "r.rollout_id", "r.n_steps"
    )


def within_group_variance(values: DataFrame) -> DataFrame:
    """Variance of the advantage left inside groups, three groupings in one pass.

    Deviations come from merged central moments (count, mean, squared deviation), which keep their digits however far the
    advantage lies from zero; each task sends one row per group.
    """
    rows = values.select("arm", "task_type", "t", step_bucket(F.col("t")).alias("bucket"), "tau")
    sets = rows.groupingSets(
        [["arm"], ["arm", "task_type"], ["arm", "t"], ["arm", "task_type", "bucket"]],
        "arm",
        "task_type",
        "t",
        "bucket",
    ).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.var_pop("tau").alias("v")
    )
    label = (
        F.when(F.col("gid") == 7, "total")
        .when(F.col("gid") == 3, "task_type")
        .when(F.col("gid") == 5, "step")
        .otherwise("type_x_bucket")
    )
    parts = sets.select("arm", label.alias("grouping"), "n", (F.col("v") * F.col("n")).alias("dev"))
    per = parts.groupBy("arm", "grouping").agg((F.sum("dev") / F.sum("n")).alias("within_var"))
    total = per.where("grouping = 'total'").select("arm", F.col("within_var").alias("total"))
    # One total per arm.
    return per.where("grouping <> 'total'").join(F.broadcast(total), "arm").select(
        "arm", "grouping", "within_var", (F.col("within_var") / nonzero(F.col("total"))).alias("retained")
    )


def spread_table(values: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, sd, min, max of several columns, one row per (arm, column)."""
    stacked = values.select(
        "arm", F.explode(F.array(*[F.struct(F.lit(c).alias("quantity"), F.col(c).alias("x")) for c in cols])).alias("r")
    ).select("arm", "r.*")
    return stacked.groupBy("arm", "quantity").agg(
        F.avg("x").alias("mean"), sample_sd("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max")
    )


def success_histogram(values: DataFrame) -> DataFrame:
    return values.groupBy("arm", F.round("p_success_intervene", 2).alias("p_success")).agg(F.count(F.lit(1)).alias("n"))


def step_distribution(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("t").agg(F.count(F.lit(1)).alias("n"))


def top_k_per_group(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """First k rows per group; cut per task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
