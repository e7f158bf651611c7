"""From raw branch rows to action values.

The pipeline never joins raw rows back: branch rows collapse to per-attempt
sufficient statistics (counts and integer sums), the winning attempt is picked on
those, and values for any cost setting come from the same sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchwise.functions.ordered import side_by_side
from branchwise.functions.outcomes import (
    ACTIONS,
    ARMS,
    CONTINUE,
    DEFAULT,
    INTERVENE,
    QUIT,
    Utility,
    UtilityColumns,
    best_action,
    best_value,
    mean_utility,
    nonzero,
    progress,
    se_utility,
    sweep_grid,
)

KEY = ["checkpoint_id", "arm"]
RUN = (CONTINUE, INTERVENE)
SUMS = [f"{s}_{a}" for a in RUN for s in ("n", "s", "m", "mm", "sm")] + ["n_quit"]


def dedupe(branches: DataFrame, unit: Sequence[str] = ()) -> DataFrame:
    """One row per (attempt, branch id) with its number of copies.

    The outcome is packed into one bigint so the choice between differing copies is
    deterministic and the aggregate stays a hash aggregate with map-side combine.
    """
    packed = (
        F.col("n_steps_in_branch").cast("bigint") * 4
        + F.coalesce(F.col("success"), F.lit(False)).cast("bigint") * 2
        + F.coalesce(F.col("replay_verified"), F.lit(False)).cast("bigint")
    )
    # Ids mostly begin with their checkpoint's; only what follows travels, marked so that no two ids meet.
    own, size = F.startswith("branch_id", "checkpoint_id"), F.length("checkpoint_id")
    rest = F.when(own, F.concat(F.lit("="), F.substring("branch_id", size + 1, F.length("branch_id"))))
    rest = rest.otherwise(F.concat(F.lit("!"), "branch_id"))
    one = branches.select(*unit, *KEY, "src", "action", rest.alias("branch"), packed.alias("packed"))
    grouped = one.groupBy(*unit, *KEY, "src", "action", "branch").agg(
        F.count(F.lit(1)).alias("copies"), F.min("packed").alias("packed")
    )
    return grouped.select(
        *unit,
        *KEY,
        "src",
        "action",
        "copies",
        F.floor(F.col("packed") / 4).cast("bigint").alias("steps"),
        (F.floor(F.col("packed") / 2).cast("bigint") % 2).alias("won"),
        (F.col("packed") % 2).alias("verified"),
    )


def attempt_stats(branches: DataFrame, unit: Sequence[str] = ()) -> DataFrame:
    """Sufficient statistics per (checkpoint, arm, source file).

    A checkpoint's branches are its replicates, so its rows are dealt to one task once, narrow, before they are merged:
    repeated ids, sums and the choice of an attempt all follow there without moving the wide sums. ``unit`` names columns
    that follow from the checkpoint, where rows are dealt by them or by checkpoint already and so need not move.
    """
    d = dedupe(branches if unit else branches.repartition("checkpoint_id"), unit)
    aggs = [F.sum("copies").alias("n_records"), F.count(F.lit(1)).alias("n_kept")]
    for a in RUN:
        is_a = F.col("action") == a

        def total(x: Column) -> Column:
            return F.coalesce(F.sum(F.when(is_a, x)), F.lit(0))

        aggs += [
            F.count_if(is_a).alias(f"n_{a}"),
            total(F.col("won")).alias(f"s_{a}"),
            total(F.col("steps")).alias(f"m_{a}"),
            total(F.col("steps") * F.col("steps")).alias(f"mm_{a}"),
            total(F.col("steps") * F.col("won")).alias(f"sm_{a}"),
        ]
    aggs += [
        F.count_if(F.col("action") == QUIT).alias("n_quit"),
        F.count_if(~F.col("action").isin(*ACTIONS)).alias("n_unknown"),
        F.count_if((F.col("action") != QUIT) & (F.col("verified") == 0)).alias("n_unverified"),
        F.count_if(F.col("verified") == 0).alias("n_unverified_any"),
    ]
    return d.groupBy(*unit, *KEY, "src").agg(*aggs)


def select_attempts(stats: DataFrame, unit: Sequence[str] = ()) -> DataFrame:
    """Per (checkpoint, arm) the attempt with most records, ties to the first file name."""
    w = Window.partitionBy(*unit, *KEY).orderBy(F.col("n_records").desc(), "src")
    return stats.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def attempt_winners(branches: DataFrame) -> DataFrame:
    """(checkpoint, arm) -> winning source, from record counts only."""
    counts = branches.groupBy(*KEY, "src").agg(F.count(F.lit(1)).alias("n_records"))
    return select_attempts(counts)


def selected_branches(branches: DataFrame) -> DataFrame:
    """Row form of attempt selection: raw rows of the winning attempt, one per branch id."""
    # Rows are dealt by checkpoint once and counted beside themselves, so they are read once.
    attempt, group = Window.partitionBy(*KEY, "src"), Window.partitionBy(*KEY)
    known = branches.where(F.col("checkpoint_id").isNotNull() & F.col("arm").isNotNull())
    counted = known.repartition("checkpoint_id").withColumn("_n", F.count(F.lit(1)).over(attempt))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("src").alias("s"))).over(group)["s"]
    kept = counted.withColumn("_best", best).where(F.col("src") == F.col("_best")).drop("_n", "_best")
    others = [c for c in branches.columns if c != "branch_id"]
    first = kept.groupBy("branch_id").agg(F.min(F.struct(*others)).alias("r"))
    return first.select("branch_id", "r.*").select(*branches.columns)


def attempt_report(stats: DataFrame) -> DataFrame:
    """What attempt selection dropped, in one row."""
    per = stats.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_src"),
        F.sum("n_records").alias("total"),
        F.max("n_records").alias("kept"),
    )
    won = select_attempts(stats).agg(F.sum(F.col("n_records") - F.col("n_kept")).alias("duplicate_branch_ids_dropped"))
    over = per.agg(
        F.count_if(F.col("n_src") > 1).alias("checkpoints_with_multiple_sources"),
        F.sum(F.col("total") - F.col("kept")).alias("records_superseded"),
    )
    return side_by_side([over, won])


def records_per_source(stats: DataFrame) -> DataFrame:
    return select_attempts(stats).groupBy("src").agg(F.sum("n_kept").alias("records"))


def cohort_of(src: Column) -> Column:
    """Execution cohort from a shard name: third dot part, ``original`` without one."""
    parts = F.split(src, r"\.")
    return F.when(F.size(parts) >= 4, F.get(parts, F.lit(2))).otherwise(F.lit("original"))


def expected_replicates(n_replicates: dict[str, int]) -> Column:
    want = F.lit(None).cast("bigint")
    for arm, n in n_replicates.items():
        want = F.when(F.col("arm") == arm, F.lit(n).cast("bigint")).otherwise(want)
    return want


def census(selected: DataFrame, n_replicates: dict[str, int]) -> DataFrame:
    """Completeness of every group with the reason, first failing rule wins."""
    want = expected_replicates(n_replicates)
    targets = {CONTINUE: want, INTERVENE: want, QUIT: F.lit(1).cast("bigint")}
    have = {a: F.col(f"n_{a}") for a in ACTIONS}
    names = sorted(ACTIONS)

    def listing(sign: str, gap) -> Column:
        parts = [F.when(gap(a) > 0, F.concat(F.lit(f"{a}{sign}"), gap(a).cast("string"))) for a in names]
        return F.concat_ws(",", *parts)

    short = listing("-", lambda a: targets[a] - have[a])
    over = listing("+", lambda a: have[a] - targets[a])
    reason = (
        F.when(F.col("n_unverified") > 0, F.lit("unverified_replay"))
        .when(short != "", F.concat(F.lit("short:"), short))
        .when(over != "", F.concat(F.lit("DUPLICATE_RECORDS:"), over))
        .otherwise(F.lit("ok"))
    )
    # Stated on the counts, so a filter on it never evaluates the reason text.
    full = (F.col("n_unverified") == 0) & (F.col("n_quit") == 1)
    for a in RUN:
        full = full & (have[a] == want)
    return (
        selected.withColumn("verified", F.col("n_unverified") == 0)
        .withColumn("reason", reason)
        .withColumn("complete", full)
        .withColumn("cohort", cohort_of(F.col("src")))
    )


def complete_groups(branches: DataFrame, n_replicates: dict[str, int], unit: Sequence[str] = ()) -> DataFrame:
    return census(select_attempts(attempt_stats(branches, unit), unit), n_replicates).where("complete")


def usable_checkpoints(branches: DataFrame) -> DataFrame:
    """Checkpoints where every row, quit included, is verified."""
    ok = F.coalesce(F.col("replay_verified"), F.lit(False))
    return branches.groupBy("checkpoint_id").agg(F.bool_and(ok).alias("ok")).where("ok").select("checkpoint_id")


def with_values(groups: DataFrame, p: UtilityColumns) -> DataFrame:
    """Add values, errors and everything derived from them to sufficient statistics."""
    cost = {CONTINUE: p.continue_cost, INTERVENE: p.intervention_cost}
    out = groups
    for a in RUN:
        n, s, m, mm, sm = (F.col(f"{x}_{a}") for x in ("n", "s", "m", "mm", "sm"))
        out = (
            out.withColumn(f"value_{a}", mean_utility(n, s, m, cost[a], p))
            .withColumn(f"se_{a}", se_utility(n, s, m, mm, sm, p))
            .withColumn(f"p_success_{a}", s / nonzero(n))
            .withColumn(f"mean_steps_{a}", m / nonzero(n))
        )
    vc, vi = F.col("value_continue"), F.col("value_intervene")
    sc, si = F.col("se_continue"), F.col("se_intervene")
    return (
        out.withColumn("tau", vi - vc)
        .withColumn("tau_se", F.sqrt(sc * sc + si * si))
        .withColumn("p_fail_continue", F.lit(1.0) - F.col("p_success_continue"))
        .withColumn("oracle_action", best_action(vc, vi))
        .withColumn("oracle_value", best_value(vc, vi))
    )


def checkpoint_values(groups: DataFrame, params: Utility = DEFAULT) -> DataFrame:
    """One wide row per (checkpoint, arm): the three actions side by side."""
    v = with_values(groups, params.columns())
    return (
        v.withColumn("utility_params", F.lit(params.name))
        .withColumn("value_quit", F.lit(0.0))
        .withColumn("se_quit", F.lit(0.0))
        .withColumn("p_success_quit", F.lit(0.0))
        .withColumn("mean_steps_quit", F.lit(0.0))
    )


def strict_values(branches: DataFrame, params: Utility = DEFAULT) -> DataFrame:
    """Values straight from rows the caller vouches for; any violation fails the job."""
    stats = attempt_stats(branches.withColumn("src", F.lit("")))

    def fail(text: str) -> Column:
        return F.raise_error(F.concat(F.lit(text), F.col("checkpoint_id"))).cast("bigint")

    checked = stats.withColumn(
        "n_unverified",
        F.when(F.col("n_unknown") > 0, fail("unknown action in "))
        .when(F.col("n_unverified") > 0, fail("unverified branch in "))
        .when((F.col("n_continue") == 0) | (F.col("n_intervene") == 0), fail("missing action in "))
        .otherwise(F.col("n_unverified")),
    ).where(F.col("n_unverified") == 0)
    return checkpoint_values(checked, params)


def derive(
    branches: DataFrame,
    n_replicates: dict[str, int],
    checkpoints: DataFrame | None = None,
    tasks: DataFrame | None = None,
    rollouts: DataFrame | None = None,
    params: Utility = DEFAULT,
    unit: Sequence[str] = (),
) -> DataFrame:
    """Complete groups with values, joined to checkpoint, task and rollout columns.

    With ``unit`` (see ``attempt_stats``) ``checkpoints`` has one row per unit, which all its checkpoints share.
    """
    v = checkpoint_values(complete_groups(branches, n_replicates, unit), params)
    if checkpoints is None:
        return v.drop(*unit)
    v = v.join(checkpoints, list(unit) or "checkpoint_id").drop(*unit)
    if tasks is not None:
        v = v.join(tasks.select("task_id", "task_type"), "task_id", "left")
        v = v.withColumn("task_type", F.coalesce("task_type", F.lit("?")))
    if rollouts is not None:
        v = v.join(rollouts.select("rollout_id", "n_steps"), "rollout_id", "left")
        v = v.withColumn("progress", progress(F.col("t"), F.col("n_steps")))
    return v


def long_values(values: DataFrame) -> DataFrame:
    """One row per (checkpoint, arm, action)."""
    rows = [
        F.struct(
            F.lit(a).alias("action"),
            (F.col(f"n_{a}") if a != QUIT else F.lit(1)).cast("bigint").alias("n"),
            F.col(f"value_{a}").alias("value"),
            F.col(f"se_{a}").alias("se"),
            F.col(f"p_success_{a}").alias("p_success"),
            F.col(f"mean_steps_{a}").alias("mean_steps"),
        )
        for a in ACTIONS
    ]
    return values.select(*KEY, F.explode(F.array(*rows)).alias("r")).select(*KEY, "r.*")


def value_cells(groups: DataFrame) -> DataFrame:
    """Distinct sufficient statistics per arm with their multiplicity.

    Counts and sums are small integers, so the number of cells is bounded by the
    replicate count and episode cap, not by the number of checkpoints.
    """
    return groups.groupBy("arm", *SUMS).agg(F.count(F.lit(1)).alias("weight"))


def swept_cells(groups: DataFrame, grid: list[Utility] | None = None) -> DataFrame:
    """Value cells under every cost setting; the grid multiplies cells, not checkpoints."""
    settings = F.array(
        *[
            F.struct(
                F.lit(u.name).alias("params"),
                F.lit(u.intervention_cost).alias("c"),
                F.lit(u.wrong_penalty).alias("w"),
                F.lit(u.continue_cost).alias("cc"),
                F.lit(u.step_cost).alias("st"),
            )
            for u in (grid or sweep_grid())
        ]
    )
    cells = value_cells(groups).select("*", F.explode(settings).alias("u")).select("*", "u.*").drop("u")
    p = UtilityColumns(F.col("w"), F.col("c"), F.col("cc"), F.col("st"))
    return with_values(cells, p)


def flip_rate(branches: DataFrame, groups: DataFrame, arm: str, params: Utility = DEFAULT) -> DataFrame:
    """How often one intervene replicate alone would change the best action.

    Each intervene row meets its group's sums once; nothing is paired.
    """
    v = with_values(groups.where(F.col("arm") == arm), params.columns())
    side = v.select("checkpoint_id", "src", "value_continue", "oracle_action", "n_intervene", "s_intervene")
    one = dedupe(branches.where((F.col("arm") == arm) & (F.col("action") == INTERVENE)))
    joined = one.join(side, ["checkpoint_id", "src"]).where("n_intervene >= 2")
    p = params.columns()
    single = mean_utility(F.lit(1), F.col("won"), F.col("steps"), p.intervention_cost, p)
    joined = joined.withColumn("flip", best_action(F.col("value_continue"), single) != F.col("oracle_action"))
    trials = joined.agg(F.count(F.lit(1)).alias("trials"), F.count_if("flip").alias("flips"))
    n, s = F.col("n_intervene"), F.col("s_intervene")
    sd = F.sqrt((n * s - s * s) / nonzero(n * (n - 1)))
    spread = side.where("n_intervene >= 2").agg(
        F.count(F.lit(1)).alias("n_checkpoints"),
        F.count_if((s > 0) & (s < n)).alias("n_varying"),
        F.avg(sd).alias("mean_success_sd"),
    )
    both = side_by_side([trials, spread])
    return both.withColumn("flip_rate", F.col("flips") / F.greatest(F.col("trials"), F.lit(1))).withColumn(
        "varying_share", F.col("n_varying") / F.greatest(F.col("n_checkpoints"), F.lit(1))
    )
