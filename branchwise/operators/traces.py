"""Recorded traces: prefixes, checkpoint picks, step-by-step verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchwise.functions.ids import derive_seed

SCALARS = ("obs", "reward", "done", "won")
LISTS = ("commands", "facts")


def list_diff(expected: Column, actual: Column, keep: int = 10) -> Column:
    """Sorted one-sided differences (first ten of each) with both lengths; null when equal."""
    return F.when(
        ~expected.eqNullSafe(actual),
        F.struct(
            F.slice(F.array_sort(F.array_except(expected, actual)), 1, keep).alias("only_expected"),
            F.slice(F.array_sort(F.array_except(actual, expected)), 1, keep).alias("only_actual"),
            F.size(expected).alias("n_expected"),
            F.size(actual).alias("n_actual"),
        ),
    )


def scalar_diff(expected: Column, actual: Column) -> Column:
    return F.when(
        ~expected.eqNullSafe(actual),
        F.struct(expected.cast("string").alias("expected"), actual.cast("string").alias("actual")),
    )


def signature_diff(expected: Column, actual: Column, fields: list[str]) -> Column:
    """Field-level difference of two state structs; equal fields are null."""
    parts = []
    for f in fields:
        make = list_diff if f in LISTS else scalar_diff
        parts.append(make(expected[f], actual[f]).alias(f))
    return F.struct(*parts)


def verify(
    recorded: DataFrame, observed: DataFrame, keys: list[str], pos: str, fields: list[str], ignore: tuple[str, ...] = ()
) -> DataFrame:
    """First divergence per trace.

    Steps meet on (trace, step), so a trace of any length is spread over all tasks
    and only its first bad step survives the map-side aggregate. A missing step on
    either side is a caller error, kept apart from a mismatch.
    """
    used = [f for f in fields if f not in ignore]
    canon = [F.array_sort(f).alias(f) if f == "commands" else F.col(f) for f in used]
    e = recorded.select(*keys, pos, "action", F.struct(*canon).alias("e"))
    a = observed.select(*keys, pos, F.struct(*canon).alias("a"))
    j = e.join(a, [*keys, pos], "full")
    differs = F.lit(False)
    for f in used:
        differs = differs | ~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}"))
    both = F.col("e").isNotNull() & F.col("a").isNotNull()
    first = F.struct(F.col(pos).alias("pos"), "action", signature_diff(F.col("e"), F.col("a"), used).alias("diff"))
    per = j.groupBy(*keys).agg(
        F.count("e").alias("n_expected"),
        F.count("a").alias("n_observed"),
        F.count_if(~both).alias("n_unpaired"),
        F.min(F.when(both & differs, first)).alias("bad"),
    )
    out = per.withColumn("length_error", F.col("n_unpaired") > 0).withColumn(
        "verified", F.col("bad").isNull() & (F.col("n_unpaired") == 0)
    )
    index = F.col("bad.pos") - 1
    return out.select(
        *keys,
        "n_expected",
        "n_observed",
        "length_error",
        "verified",
        index.alias("step_index"),
        F.col("bad.action").alias("action"),
        F.col("bad.diff").alias("diff"),
        F.when(F.col("verified"), F.lit(1.0)).otherwise(index / (index + 1)).alias("match_rate"),
    )


def rejected_branches(branches: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Flag branches whose trace diverged; they are kept with no steps, but never valued.

    Only a negative verdict rejects. A branch without a verdict keeps what it says and is not verified (null).
    """
    v = verdicts.select(key, F.col("verified").alias("_ok"))
    j = branches.join(v, key, "left")
    bad = F.coalesce(~F.col("_ok"), F.lit(False))
    out = (
        j.withColumn("replay_verified", F.col("_ok"))
        .withColumn("terminal_reason", F.when(bad, "replay_mismatch").otherwise(F.col("terminal_reason")))
        .withColumn("success", F.when(bad, F.lit(False)).otherwise(F.col("success")))
    )
    if "n_steps_in_branch" in branches.columns:
        out = out.withColumn("n_steps_in_branch", F.when(bad, 0).otherwise(F.col("n_steps_in_branch")))
    return out.drop("_ok")


def pick_checkpoints(rollouts: DataFrame, k: int = 4, id_col: str = "rollout_id") -> DataFrame:
    """Up to ``k`` steps per rollout, one seeded pick in each of k equal bins.

    Steps 1..n-1 qualify. At most k rows come from a rollout, all from its own row.
    """
    n = F.col("n_steps").cast("bigint") - 1
    bins = F.sequence(F.lit(0), F.lit(k - 1))

    def pick(i: Column) -> Column:
        lo = F.floor(i * n / k)
        width = F.greatest(F.floor((i + 1) * n / k) - lo, F.lit(1))
        return (1 + lo + derive_seed(F.col(id_col), F.lit("cp"), i) % width).cast("bigint")

    few = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1)))).otherwise(
        F.array().cast("array<bigint>")
    )
    chosen = F.when(n <= k, few).otherwise(F.array_distinct(F.transform(bins, pick)))
    return rollouts.select("*", F.explode(chosen).alias("t"))


def prefixes(checkpoints: DataFrame, steps: DataFrame, trace: str, payload: list[str], out: str) -> DataFrame:
    """Ordered step list up to each checkpoint, from the flat step table.

    Each rollout has at most k checkpoints, so a step is copied at most k times,
    and a list is bounded by the episode cap because it becomes one cell.
    """
    s = steps.select(F.col(trace), F.col("t").alias("_t"), *payload)
    j = checkpoints.join(s, trace).where(F.col("_t") <= F.col("t"))
    rows = j.groupBy(*checkpoints.columns).agg(F.array_sort(F.collect_list(F.struct("_t", *payload))).alias(out))
    return rows


def steps_of(rollouts: DataFrame) -> DataFrame:
    """Nested rollout records to the flat step table, initial state at position 0."""
    state = ["obs", "reward", "done", "won", "admissible_commands", "facts"]
    s = rollouts.select("rollout_id", F.posexplode("steps").alias("i", "s"))
    later = s.select("rollout_id", (F.col("i") + 1).cast("bigint").alias("t"), F.col("s.action").alias("action"), *[F.col(f"s.{c}").alias(c) for c in state])
    first = rollouts.select(
        "rollout_id", F.lit(0).cast("bigint").alias("t"), F.lit(None).cast("string").alias("action"), *[F.col(f"initial.{c}").alias(c) for c in state]
    )
    return first.unionByName(later)
