"""Risk bands and what is lost by routing on risk alone.

Rows first merge into one row per distinct risk level: all band statistics are
sums, counts and extremes, so bands are unions of levels and no row is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchwise.functions.outcomes import ACTIONS, best_action, nonzero, value_of

N_BINS = 10


def binned(levels: DataFrame, keys: list[str], risk: str = "risk", weight: str = "n", n_bins: int = N_BINS) -> DataFrame:
    """Band number per distinct risk level.

    Up to ``n_bins`` distinct levels give a band each; beyond that the inner
    quantile edges cut them and the band is the number of edges below the level.
    Levels per key are bounded by the replicate count, since risk is a ratio of
    whole numbers of replicates.
    """
    probs = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    per = Window.partitionBy(*keys)
    order = per.orderBy(risk)
    return (
        levels.withColumn("_levels", F.count(F.lit(1)).over(per))
        .withColumn("_rank", F.dense_rank().over(order) - 1)
        .withColumn("_edges", F.percentile(risk, probs, F.col(weight)).over(per))
        .withColumn(
            "bin",
            F.when(F.col("_levels") <= n_bins, F.col("_rank"))
            .otherwise(F.size(F.filter("_edges", lambda e: e < F.col(risk))))
            .cast("int"),
        )
        .drop("_levels", "_rank", "_edges")
    )


def risk_levels(values: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Mergeable statistics per distinct risk level.

    Grouping is on the whole-number counts behind the ratio, not on the float. Without a weight they include ``dev_tau``, the
    squared deviation of the advantage from its level's mean, which keeps its digits however far the mean lies from zero.
    """
    w = F.lit(1) if weight is None else weight
    tau = F.col("tau")
    sums = [
        F.sum(w).alias("n"),
        F.sum(F.col("value_continue") * w).alias("sum_continue"),
        F.sum(F.col("value_intervene") * w).alias("sum_intervene"),
        F.sum(F.col("oracle_value") * w).alias("sum_best"),
        F.sum(tau * w).alias("sum_tau"),
        F.min("tau").alias("min_tau"),
        F.max("tau").alias("max_tau"),
    ]
    sums += [F.sum(F.when(F.col("oracle_action") == a, w).otherwise(0)).alias(f"best_{a}") for a in ACTIONS]
    if weight is None:
        sums.append((F.var_pop("tau") * F.count("tau")).alias("dev_tau"))
    g = values.groupBy(*keys, "n_continue", "s_continue").agg(*sums)
    return g.withColumn("risk", F.lit(1.0) - F.col("s_continue") / nonzero(F.col("n_continue")))


MERGE_SUM = ["n", "sum_continue", "sum_intervene", "sum_best", "sum_tau"] + [f"best_{a}" for a in ACTIONS]


def band_stats(values: DataFrame, keys: list[str], weight: Column | None = None, n_bins: int = N_BINS) -> DataFrame:
    """Statistics per band."""
    banded = binned(risk_levels(values, keys, weight), keys, n_bins=n_bins)
    sums = list(MERGE_SUM)
    if weight is None:
        # Levels of a band merge by their own deviations and those of their means; a key has few levels.
        band = Window.partitionBy(*keys, "bin")
        mean = F.sum("sum_tau").over(band) / F.sum("n").over(band)
        apart = F.col("sum_tau") / F.col("n") - mean
        banded = banded.withColumn("dev_tau", F.col("dev_tau") + F.col("n") * apart * apart)
        sums.append("dev_tau")
    return banded.groupBy(*keys, "bin").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.sum(F.col("risk") * F.col("n")).alias("sum_risk"),
        F.min("min_tau").alias("min_tau"),
        F.max("max_tau").alias("max_tau"),
    )


def _band_best(b: DataFrame) -> Column:
    """Value sum of the one action picked for the whole band."""
    pick = best_action(F.col("sum_continue"), F.col("sum_intervene"))
    return value_of(pick, F.col("sum_continue"), F.col("sum_intervene"))


def _is_mixed() -> Column:
    kinds = sum((F.when(F.col(f"best_{a}") > 0, 1).otherwise(0) for a in ACTIONS), F.lit(0))
    return kinds > 1


def abstraction_loss(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Value lost when one action is chosen per band, and the conflicted share."""
    return bands.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum("sum_best") / F.sum("n")).alias("oracle_value"),
        ((F.sum("sum_best") - F.sum(_band_best(bands))) / F.sum("n")).alias("gap"),
        (F.sum(F.when(_is_mixed(), F.col("n")).otherwise(0)) / F.sum("n")).alias("conflict_mass"),
        (F.sum("best_intervene") / F.sum("n")).alias("intervene_share"),
    )


def conflict_detail(bands: DataFrame) -> DataFrame:
    """Best-action counts per band."""
    return bands.withColumn("mixed", _is_mixed())


def tau_spread(bands: DataFrame) -> DataFrame:
    """Spread of the intervention advantage inside each (unweighted) band of two rows or more."""
    n = F.col("n")
    return bands.where("n >= 2").select(
        *[c for c in bands.columns if c not in MERGE_SUM + ["sum_risk", "dev_tau"]],
        "n",
        (F.col("sum_risk") / n).alias("risk_mean"),
        (F.col("sum_tau") / n).alias("tau_mean"),
        F.sqrt(F.col("dev_tau") / nonzero(n - 1)).alias("tau_sd"),
        ((F.col("min_tau") < 0) & (F.col("max_tau") > 0)).alias("straddles_zero"),
    )


def bin_purity(values: DataFrame, keys: list[str]) -> DataFrame:
    """Best-action counts per distinct risk value and whether one action takes all."""
    return risk_levels(values, keys).select(
        *keys,
        "risk",
        "n",
        *[f"best_{a}" for a in ACTIONS],
        F.when(_is_mixed(), "mixed").otherwise("PURE").alias("purity"),
    )


def top_band(values: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the highest risk level per key.

    The maximum is one number per arm, so the joined side has as many rows as arms.
    """
    top = values.groupBy(*keys).agg(F.max("p_fail_continue").alias("_top"))
    j = values.join(F.broadcast(top), keys)
    return j.where(F.abs(F.col("p_fail_continue") - F.col("_top")) < 1e-9).drop("_top")


def pinned_band(values: DataFrame, keys: list[str], target: float = 1.0) -> DataFrame:
    """Rows of the level closest to ``target`` per key (ties to the lower level)."""
    best = values.groupBy(*keys).agg(
        F.min(F.struct(F.abs(F.col("p_fail_continue") - target).alias("d"), F.col("p_fail_continue").alias("v"))).alias("_b")
    )
    j = values.join(F.broadcast(best), keys)
    return j.where(F.abs(F.col("p_fail_continue") - F.col("_b.v")) < 1e-9).drop("_b")
