"""Data-quality suite and run audit. Each check is one row: id, status, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchwise.functions.ordered import exact_positions
from branchwise.functions.outcomes import ARM_A, ARM_B, CONTINUE, DEFAULT, INTERVENE, QUIT
from branchwise.operators import values as V
from branchwise.operators.splits import leakage

COLUMNS = ("check_id", "check_name", "status", "n_checked", "n_bad", "measure")


def _row(agg: DataFrame, cid: str, name: str, passed: Column, checked, bad, measure, skip: Column | None = None) -> DataFrame:
    status = F.when(passed, "PASS").otherwise("FAIL")
    if skip is not None:
        status = F.when(skip, "SKIP").otherwise(status)
    return agg.select(
        F.lit(cid).alias("check_id"),
        F.lit(name).alias("check_name"),
        status.alias("status"),
        F.coalesce(checked.cast("bigint"), F.lit(0)).alias("n_checked"),
        F.coalesce(bad.cast("bigint"), F.lit(0)).alias("n_bad"),
        measure.cast("double").alias("measure"),
    )


C = F.col


def verified_rows(branches: DataFrame) -> DataFrame:
    """Every executed row is verified."""
    a = branches.where(C("action") != QUIT).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce("replay_verified", F.lit(False))).alias("bad")
    )
    return _row(a, "V1", "replay fidelity", C("bad") == 0, C("n"), C("bad"), 1 - C("bad") / F.greatest(C("n"), F.lit(1)))


def planted_corruption(recorded: DataFrame, keys: list[str], pos: str, fields: list[str], share: str = "0") -> DataFrame:
    """Corrupt the first state of hash-chosen traces; verification must catch each one.

    ``share`` is the hash digit that selects a trace for the damage.
    """
    from branchwise.operators.traces import verify

    chosen = F.substring(F.md5(F.concat_ws("|", *keys)), 1, 1) == share
    damaged = recorded.withColumn(
        "obs",
        F.when(chosen & (C(pos) == 1), F.when(C("action") != "look", "look").otherwise("inventory")).otherwise(C("obs")),
    )
    v = verify(recorded, damaged, keys, pos, fields).withColumn("hit", chosen)
    a = v.agg(
        F.count_if("hit").alias("n"),
        F.count_if(C("hit") & C("verified")).alias("missed"),
        F.count_if(~C("hit") & ~C("verified")).alias("false_alarms"),
    )
    ok = (C("n") > 0) & (C("missed") == 0) & (C("false_alarms") == 0)
    return _row(a, "V2", "negative control", ok, C("n"), C("missed"), C("false_alarms"))


def _against(stored: DataFrame, recomputed: DataFrame, keys: list[str], col: str, damaged: Column | None) -> DataFrame:
    """(n, off, bad) of stored rows: differing from the recomputed value, and differing where no damage was planted or
    not differing where some was."""
    hit = F.lit(False) if damaged is None else damaged
    s = stored.select(*keys, C(col).alias("s"), hit.alias("hit"))
    j = s.join(recomputed.select(*keys, C(col).alias("r")), keys, "left")
    off = ~C("s").eqNullSafe(C("r"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off"), F.count_if(off != C("hit")).alias("bad"))


def stored_hashes(stored: DataFrame, recomputed: DataFrame, keys: list[str], col: str, damaged: Column | None = None) -> DataFrame:
    """A stored hash column equals the recomputed one on the same key, but exactly where damage was planted."""
    a = _against(stored, recomputed, keys, col, damaged)
    return _row(a, "V3", "stored state hash", (C("n") > 0) & (C("bad") == 0), C("n"), C("bad"), C("off"))


def _outcome_kinds(branches: DataFrame, arm: str) -> DataFrame:
    """Rows and spread of (success, length) per checkpoint, continue rows of one arm."""
    rows = branches.where((C("arm") == arm) & (C("action") == CONTINUE) & C("replay_verified"))
    packed = C("n_steps_in_branch") * 2 + C("success").cast("int")
    return rows.groupBy("checkpoint_id").agg(
        F.count(F.lit(1)).alias("n"), (F.min(packed) < F.max(packed)).alias("varies")
    )


def deterministic_arm(branches: DataFrame) -> DataFrame:
    """Repeated checkpoints of the deterministic arm show one outcome only."""
    a = _outcome_kinds(branches, ARM_A).agg(
        F.count_if(C("n") > 1).alias("n"), F.count_if((C("n") > 1) & C("varies")).alias("bad")
    )
    return _row(a, "V4", "arm A determinism", C("bad") == 0, C("n"), C("bad"), C("bad"))


def stochastic_arm(branches: DataFrame) -> DataFrame:
    """The stochastic arm differs between replicates somewhere."""
    a = _outcome_kinds(branches, ARM_B).agg(F.count(F.lit(1)).alias("n"), F.count_if("varies").alias("varied"))
    share = C("varied") / F.greatest(C("n"), F.lit(1))
    return _row(a, "V5", "arm B stochasticity", C("varied") > 0, C("n"), C("n") - C("varied"), share, C("n") == 0)


def standard_error_spread(branches: DataFrame) -> DataFrame:
    """Nearest-rank middle, 90th percentile and maximum of the continue errors."""
    from branchwise.functions.outcomes import se_utility

    rows = branches.where((C("arm") == ARM_B) & (C("action") == CONTINUE) & C("replay_verified"))
    m, s = C("n_steps_in_branch").cast("bigint"), C("success").cast("bigint")
    g = rows.groupBy("checkpoint_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(s).alias("s"),
        F.sum(m).alias("m"),
        F.sum(m * m).alias("mm"),
        F.sum(s * m).alias("sm"),
    )
    se = g.select(se_utility(C("n"), C("s"), C("m"), C("mm"), C("sm"), DEFAULT.columns()).alias("se"))
    n = C("_n")
    got = exact_positions(se, [], "se", {0.5: F.floor(n / 2), 0.9: F.floor(F.lit(0.9) * (n - 1)), 1.0: n - 1})

    def at(p: float) -> Column:
        return F.max(F.when(F.abs(C("prob") - p) < 1e-9, C("quantile")))

    return got.agg(at(0.5).alias("se_p50"), at(0.9).alias("se_p90"), at(1.0).alias("se_max"))


def takeover_success(branches: DataFrame, checkpoints: DataFrame, tasks: DataFrame, floor: float = 0.85) -> DataFrame:
    """Success of stored intervene rows against a floor."""
    a = branches.where(C("action") == INTERVENE).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~C("success")).alias("bad")
    )
    rate = 1 - C("bad") / F.greatest(C("n"), F.lit(1))
    return _row(a, "V6", "takeover success", rate >= floor, C("n"), C("bad"), rate)


def worst_task_type(branches: DataFrame, checkpoints: DataFrame, tasks: DataFrame) -> DataFrame:
    """Task type with the lowest takeover success.

    Outcomes merge per checkpoint first, so the joins move one row per checkpoint.
    """
    per = branches.where(C("action") == INTERVENE).groupBy("checkpoint_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("s")
    )
    t = per.join(checkpoints.select("checkpoint_id", "task_id"), "checkpoint_id").join(tasks, "task_id", "left")
    rates = t.groupBy("task_type").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return rates.agg(F.min(F.struct((C("s") / C("n")).alias("rate"), "task_type", "n")).alias("r")).select("r.*")


def base_success(rollouts: DataFrame, lo: float = 0.15, hi: float = 0.60) -> DataFrame:
    a = rollouts.agg(F.count(F.lit(1)).alias("n"), F.count_if(~C("success")).alias("bad"))
    rate = 1 - C("bad") / F.greatest(C("n"), F.lit(1))
    return _row(a, "V7", "base success band", rate.between(lo, hi), C("n"), C("bad"), rate, C("n") == 0)


def no_leakage(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """No group straddles splits, for several (split, group) pairs."""
    found = [
        leakage(rows, s, g).select(F.lit(f"{s}/{g}").alias("pair"), C(g).cast("string").alias("group_id")) for s, g in pairs
    ]
    a = reduce(DataFrame.unionByName, found).agg(F.count(F.lit(1)).alias("bad"))
    return _row(a, "V8", "split leakage", C("bad") == 0, F.lit(len(pairs)), C("bad"), C("bad"))


def order_free(branches: DataFrame, n_replicates: dict[str, int]) -> DataFrame:
    """Values from a reshuffled copy are identical, bit for bit."""
    cols = ["checkpoint_id", "arm", "tau", "tau_se", "oracle_action", "oracle_value", "value_continue", "value_intervene"]
    one = V.derive(branches, n_replicates).select(*cols)
    mixed = branches.repartition(F.md5("branch_id"))
    two = V.derive(mixed, n_replicates).select(*cols)
    names = cols[2:]
    j = one.join(two.select(*cols[:2], *[C(c).alias(f"o_{c}") for c in names]), cols[:2], "full")
    same = reduce(lambda x, y: x & y, [C(c).eqNullSafe(C(f"o_{c}")) for c in names])
    a = j.agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("bad"))
    return _row(a, "V9", "derivation purity", C("bad") == 0, C("n"), C("bad"), C("bad"))


def stored_arrays(stored: DataFrame, recomputed: DataFrame, keys: list[str], col: str, damaged: Column | None = None) -> DataFrame:
    """A stored array column equals the recomputed one, but exactly where damage was planted; missing arrays are skipped."""
    a = _against(stored.where(C(col).isNotNull()), recomputed, keys, col, damaged)
    return _row(a, "V10", "stored column round trip", C("bad") == 0, C("n"), C("bad"), C("off"), C("n") == 0)


def evaluation_guard(rows: DataFrame, group: str, n_rows: int, n_groups: int) -> DataFrame:
    """Fail the job unless row and group counts are the expected ones."""
    a = rows.groupBy(group).agg(F.count(F.lit(1)).alias("m")).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("g"))
    bad = (C("n") != n_rows) | (C("g") != n_groups)
    message = F.format_string("evaluation set changed: %d rows, %d groups", C("n"), C("g"))
    return a.select(F.when(bad, F.raise_error(message).cast("bigint")).otherwise(C("n")).alias("n_rows"), C("g").alias("n_groups"))


def two_paths_agree(a: DataFrame, b: DataFrame, keys: list[str], score: str, tol: float = 5e-4) -> DataFrame:
    """Two ways to one score agree, else the results are void."""
    j = a.select(*keys, C(score).alias("x")).join(b.select(*keys, C(score).alias("y")), keys, "full")
    off = F.coalesce(F.abs(C("x") - C("y")) > tol, F.lit(True))
    g = j.agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("bad"), F.max(F.abs(C("x") - C("y"))).alias("gap"))
    return _row(g, "W1", "two paths agree", C("bad") == 0, C("n"), C("bad"), C("gap"))


def suite(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def suite_totals(checks: DataFrame) -> DataFrame:
    """Counts by status and the exit status of the run."""
    return checks.agg(
        *[F.count_if(C("status") == s).alias(s.lower()) for s in ("PASS", "FAIL", "SKIP")]
    ).withColumn("exit_status", F.when(C("fail") > 0, 1).otherwise(0))


# ------------------------------------------------------------------- audit


def planned_classes(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """Every planned or observed unit: complete, partial, absent or orphan."""
    p = planned.select("checkpoint_id").distinct().withColumn("planned", F.lit(True))
    j = p.join(observed.select("checkpoint_id", "complete", "reason"), "checkpoint_id", "full")
    label = (
        F.when(C("planned").isNull(), "orphan")
        .when(C("complete").isNull(), "absent")
        .when(C("complete"), "complete")
        .otherwise("partial")
    )
    return j.select("checkpoint_id", label.alias("class"), "reason")


def class_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def partial_reasons(classes: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent reasons for partial units; a top-k report."""
    return (
        classes.where(C("class") == "partial")
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(C("n").desc(), "reason")
        .limit(k)
    )


def rerun_list(classes: DataFrame) -> DataFrame:
    return classes.where(C("class").isin("partial", "absent")).select("checkpoint_id")


def remaining_units(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """Planned units without a complete result yet."""
    return planned.join(observed.where("complete").select("checkpoint_id"), "checkpoint_id", "left_anti")


def lost_games(checkpoints: DataFrame, complete: DataFrame, game: str = "task_id") -> DataFrame:
    """Games without a single usable checkpoint."""
    done = complete.select("checkpoint_id").withColumn("ok", F.lit(1))
    j = checkpoints.select("checkpoint_id", game).join(done, "checkpoint_id", "left")
    return j.groupBy(game).agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("usable")).where("usable = 0").select(game, "n")
