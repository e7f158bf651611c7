"""Scalar rules on outcomes: utility, best action, progress, buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three actions in tie-break order, the arms, their replicate
# counts in the test views and the default utility parameters.
CONTINUE, INTERVENE, QUIT = "continue", "intervene", "quit"
ACTIONS = (CONTINUE, INTERVENE, QUIT)
ARM_A, ARM_B = "A_replication", "B_montecarlo"
ARMS = (ARM_A, ARM_B)
TERMINAL_REASONS = (
    "goal",
    "step_cap",
    "expert_failed",
    "expert_timeout",
    "parse_error",
    "quit",
    "replay_mismatch",
)
SWEEP_COSTS = (0.0, 0.05, 0.10, 0.15, 0.20)
SWEEP_PENALTIES = (0.0, 0.5, 1.0, 1.5, 2.0)


@dataclass(frozen=True)
class Utility:
    """Named utility parameters; nothing stored upstream depends on them."""

    wrong_penalty: float = 1.0
    intervention_cost: float = 0.05
    continue_cost: float = 0.0
    step_cost: float = 0.01
    name: str = "default"

    def columns(self) -> "UtilityColumns":
        return UtilityColumns(
            F.lit(self.wrong_penalty),
            F.lit(self.intervention_cost),
            F.lit(self.continue_cost),
            F.lit(self.step_cost),
        )


@dataclass(frozen=True)
class UtilityColumns:
    """The same parameters as columns, so one plan can carry many settings."""

    wrong_penalty: Column
    intervention_cost: Column
    continue_cost: Column
    step_cost: Column


DEFAULT = Utility()


def sweep_grid() -> list[Utility]:
    """The 25 cost settings of the sensitivity sweep."""
    return [
        Utility(wrong_penalty=w, intervention_cost=c, name=f"c{c:.2f}_w{w:.2f}")
        for c in SWEEP_COSTS
        for w in SWEEP_PENALTIES
    ]


def realized_utility(action: Column, success: Column, steps: Column, p: UtilityColumns) -> Column:
    """Utility of one executed outcome. Unknown actions and negative lengths fail the job."""
    outcome = F.when(success, F.lit(1.0)).otherwise(-p.wrong_penalty)
    cost = F.when(action == INTERVENE, p.intervention_cost).otherwise(p.continue_cost)
    checked = F.when(steps < 0, F.raise_error(F.lit("negative step count"))).otherwise(
        outcome - cost - p.step_cost * steps.cast("double")
    )
    return (
        F.when(action == QUIT, F.lit(0.0))
        .when(action.isin(CONTINUE, INTERVENE), checked)
        .otherwise(F.raise_error(F.concat(F.lit("unknown action: "), action)).cast("double"))
    )


def nonzero(n: Column) -> Column:
    """Divisor that is null instead of zero; filters may run after projections."""
    return F.when(n != 0, n)


def mean_utility(n: Column, succ: Column, steps: Column, cost: Column, p: UtilityColumns) -> Column:
    """Mean utility of ``n`` replicates from their success and step sums.

    Utility is linear in both, so no replicate row is needed once the sums exist.
    """
    total = succ * (F.lit(1.0) + p.wrong_penalty) - p.wrong_penalty * n - cost * n - p.step_cost * steps
    return total / nonzero(n)


def se_utility(
    n: Column, succ: Column, steps: Column, steps_sq: Column, succ_steps: Column, p: UtilityColumns
) -> Column:
    """Standard error of the mean (unbiased variance), 0 for a single replicate.

    The three bracketed terms are exact integers, so nothing cancels in floating point.
    """
    gain = F.lit(1.0) + p.wrong_penalty
    v_succ = n * succ - succ * succ
    v_steps = n * steps_sq - steps * steps
    cov = n * succ_steps - succ * steps
    spread = gain * gain * v_succ + p.step_cost * p.step_cost * v_steps - F.lit(2.0) * gain * p.step_cost * cov
    many = F.when(n > 1, n)
    return F.coalesce(F.sqrt(F.greatest(spread, F.lit(0.0)) / (many - 1)) / many, F.lit(0.0))


def best_action(v_continue: Column, v_intervene: Column, v_quit: Column | None = None) -> Column:
    """First maximum in action order, so ties go to the earlier action."""
    q = F.lit(0.0) if v_quit is None else v_quit
    return (
        F.when((v_continue >= v_intervene) & (v_continue >= q), F.lit(CONTINUE))
        .when(v_intervene >= q, F.lit(INTERVENE))
        .otherwise(F.lit(QUIT))
    )


def best_value(v_continue: Column, v_intervene: Column) -> Column:
    return F.greatest(v_continue, v_intervene, F.lit(0.0))


def value_of(action: Column, v_continue: Column, v_intervene: Column) -> Column:
    """Value of an action; null where no action was taken."""
    return F.when(action == CONTINUE, v_continue).when(action == INTERVENE, v_intervene).when(action.isNotNull(), F.lit(0.0))


def regret_of(action: Column, v_continue: Column, v_intervene: Column) -> Column:
    return best_value(v_continue, v_intervene) - value_of(action, v_continue, v_intervene)


def action_margin(v_continue: Column, v_intervene: Column) -> Column:
    """Best value minus second best."""
    ranked = F.array_sort(F.array(v_continue, v_intervene, F.lit(0.0)))
    return F.element_at(ranked, 3) - F.element_at(ranked, 2)


def action_index(action: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), action) - 1


def progress(t: Column, n_steps: Column) -> Column:
    """Share of the episode done; null when the length is missing or zero."""
    return t / F.when(n_steps > 0, n_steps)


def nano(x: Column) -> Column:
    """Fixed-point form, so tolerance tests compare whole numbers."""
    return F.round(x * F.lit(1e9)).cast("bigint")


def remaining_budget(cap: Column, t: Column) -> Column:
    return F.greatest(F.lit(0), cap - t)


def step_bucket(t: Column) -> Column:
    return F.floor(F.coalesce(t, F.lit(0)) / 10).cast("bigint")


def progress_quartile(p: Column) -> Column:
    return F.least(F.lit(4), F.floor(p * 4).cast("int") + 1)


def spo_plus_loss(qc_hat: Column, qi_hat: Column, qc: Column, qi: Column) -> Column:
    """Decision-focused surrogate loss of predicted against true action values."""
    zero = F.lit(0.0)
    shifted = F.greatest(2 * qc_hat - qc, 2 * qi_hat - qi, zero)
    picked = value_of(best_action(qc, qi), qc_hat, qi_hat)
    return shifted + best_value(qc, qi) - 2 * picked


def spo_plus_subgradient(qc_hat: Column, qi_hat: Column, qc: Column, qi: Column) -> tuple[Column, Column]:
    """Subgradient of that loss in the two free predictions."""
    up = best_action(2 * qc_hat - qc, 2 * qi_hat - qi)
    down = best_action(qc, qi)

    def side(a: str) -> Column:
        return F.when(up == a, F.lit(2.0)).otherwise(F.lit(0.0)) - F.when(down == a, F.lit(2.0)).otherwise(F.lit(0.0))

    return side(CONTINUE), side(INTERVENE)
