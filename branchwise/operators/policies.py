"""Decision policies and where their regret comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchwise.functions.ordered import exact_quantiles, quantile_columns, side_by_side
from branchwise.functions.outcomes import ACTIONS, CONTINUE, best_action, nano, regret_of, value_of
from branchwise.operators.resample import cluster_bootstrap, replicate_sums, safe, sign_stability

# Fixed value: regret above this counts as high.
HIGH_REGRET = 0.5


#: Tenths and quarters of a step between two whole units are whole at this scale.
EDGE_UNITS = 20


def with_deciles(df: DataFrame, keys: list[str], value: str, probs: list[float] | None = None, out: str = "decile") -> DataFrame:
    """Number of fixed quantile edges strictly below the value.

    Values count in whole nano units and edges in twentieths of them, where tenths and quarters between two values are whole
    numbers, so a value on an edge does not depend on a last bit. The edge table has one row per key group.
    """
    probs = probs or [i / 10 for i in range(1, 10)]
    unit = df.withColumn("_unit", nano(F.col(value)))
    at = F.round(F.col("quantile") * EDGE_UNITS).cast("bigint").alias("_at")
    scaled = F.col("_unit") * EDGE_UNITS
    if not keys:
        # A fixed handful of numbers.
        cuts = sorted(r["_at"] for r in exact_quantiles(unit, [], "_unit", probs).select(at).collect())
        below = sum((F.when(F.lit(c) < scaled, 1).otherwise(0) for c in cuts), F.lit(0))
        return unit.withColumn(out, below.cast("bigint")).drop("_unit")
    edges = exact_quantiles(unit, keys, "_unit", probs).select(*keys, at).groupBy(*keys).agg(F.collect_list("_at").alias("_e"))
    j = unit.join(edges, keys)
    return j.withColumn(out, F.size(F.filter("_e", lambda e: e < scaled)).cast("bigint")).drop("_e", "_unit")


def risk_map(rows: DataFrame, level: str = "s_continue") -> DataFrame:
    """Best single action per (seed, risk level), learned on train rows only."""
    train = rows.where(~F.col("is_test"))
    sums = train.groupBy("seed", level).agg(F.sum("qc").alias("sc"), F.sum("qi").alias("si"))
    return sums.select("seed", level, best_action(F.col("sc"), F.col("si")).alias("mapped"))


def with_risk_choice(rows: DataFrame, level: str = "s_continue") -> DataFrame:
    """Test rows with the mapped action; a level never seen in train continues.

    The map has one row per seed and risk level, a number the replicate count bounds.
    """
    test = rows.where("is_test")
    return test.join(F.broadcast(risk_map(rows, level)), ["seed", level], "left").withColumn(
        "mapped", F.coalesce("mapped", F.lit(CONTINUE))
    )


def chosen(predicted_c: Column, predicted_i: Column) -> Column:
    """Action that the predictions favour; null, so unscored, where a prediction is missing."""
    return F.when(predicted_c.isNotNull() & predicted_i.isNotNull(), best_action(predicted_c, predicted_i))


def choices(test: DataFrame, policies: dict[str, Column], keep: list[str]) -> DataFrame:
    """Long table of decisions: one row per (test row, policy)."""
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("choice")) for n, c in policies.items()])
    return test.select(*keep, F.explode(rows).alias("_p")).select(*keep, "_p.*")


def floors() -> dict[str, Column]:
    return {f"floor_{a}": F.lit(a) for a in ACTIONS}


def ladder(train_mean_qi: Column) -> dict[str, Column]:
    """All policies over prediction columns; needs ``mapped``, true values and ``p_*``."""
    c = F.col
    return floors() | {
        "risk_only": c("mapped"),
        "predict_only": chosen(c("p_qc_obs"), train_mean_qi),
        "no_intervene": chosen(c("p_qc_obs"), F.lit(-1e9)),
        "observable": chosen(c("p_qc_obs"), c("p_qi_obs")),
        "stacked": chosen(c("p_qc_obs"), c("p_qi_stack")),
        "with_vectors": chosen(c("p_qc_act"), c("p_qi_act")),
        "ceiling": chosen(c("qc"), c("qi")),
    }


def scored(decisions: DataFrame) -> DataFrame:
    """Add utility, regret and agreement; needs qc, qi, choice."""
    qc, qi, ch = F.col("qc"), F.col("qi"), F.col("choice")
    return decisions.withColumns(
        {
            "utility": value_of(ch, qc, qi),
            "regret": regret_of(ch, qc, qi),
            "agrees": (ch == best_action(qc, qi)).cast("double"),
        }
    )


def evaluate(scored_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Utility, regret profile, agreement and action mix per key.

    Keys are (seed, policy) or coarser: a fixed set, so exact quantiles apply.
    """
    means = scored_rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("utility").alias("utility"),
        F.avg("regret").alias("regret_mean"),
        F.avg((F.col("regret") > HIGH_REGRET).cast("double")).alias("high_regret"),
        F.avg("agrees").alias("agreement"),
        *[F.avg((F.col("choice") == a).cast("double")).alias(f"share_{a}") for a in ACTIONS],
    )
    q = quantile_columns(scored_rows, keys, "regret", {"regret_median": 0.5, "regret_p90": 0.9})
    return means.join(q, keys)


def contrasts(per_seed: DataFrame, pairs: list[tuple[str, str]], value: str = "regret_mean") -> DataFrame:
    """Second minus first policy per seed, then sign stability over seeds."""
    wanted = F.array(*[F.struct(F.lit(a).alias("base"), F.lit(b).alias("rich")) for a, b in pairs])
    one = per_seed.select("seed", F.col("policy").alias("base"), F.col(value).alias("vb"), F.explode(wanted).alias("w"))
    one = one.where(F.col("base") == F.col("w.base")).select("seed", "base", F.col("w.rich").alias("rich"), "vb")
    two = per_seed.select("seed", F.col("policy").alias("rich"), F.col(value).alias("vr"))
    d = one.join(two, ["seed", "rich"]).withColumn("delta", F.col("vr") - F.col("vb"))
    return sign_stability(d, ["base", "rich"], "delta")


def regret_by_level(scored_rows: DataFrame, level: str = "s_continue") -> DataFrame:
    per = scored_rows.groupBy("seed", "policy", level).agg(F.count(F.lit(1)).alias("n"), F.avg("regret").alias("regret"))
    return per.groupBy("policy", level).agg(
        F.avg("regret").alias("regret_mean"), F.coalesce(F.stddev_samp("regret"), F.lit(0.0)).alias("sd"), F.avg("n").alias("mean_n")
    )


def marginal_by_level(scored_rows: DataFrame, poor: str, rich: str, level: str = "s_continue") -> DataFrame:
    """Regret the richer policy saves per risk level, with sign stability over seeds.

    A level counts only for seeds where both policies were scored on it.
    """
    per = scored_rows.groupBy("seed", level).agg(
        F.avg(F.when(F.col("policy") == poor, F.col("regret"))).alias("a"),
        F.avg(F.when(F.col("policy") == rich, F.col("regret"))).alias("b"),
    )
    return sign_stability(per.withColumn("delta", F.col("a") - F.col("b")), [level], "delta")


def level_contrasts(scored_rows: DataFrame, contrasts: dict[str, tuple[str, str]], level: str = "s_continue") -> DataFrame:
    """Regret saved per risk level in each named (poorer, richer) contrast, with sign stability over seeds.

    A contrast is scored on a level only if both policies were scored there in the same number of splits; otherwise its
    statistics are null and ``n_poor``, ``n_rich`` tell why.
    """
    per = scored_rows.groupBy("seed", "policy", level).agg(F.avg("regret").alias("regret"))
    sides = F.array(
        *[
            F.struct(F.lit(name).alias("contrast"), F.lit(policy).alias("policy"), F.lit(i).alias("rich"))
            for name, pair in contrasts.items()
            for i, policy in enumerate(pair)
        ]
    )
    wanted = per.select("*", F.explode(F.filter(sides, lambda x: x["policy"] == F.col("policy"))).alias("x"))
    rich = F.col("x.rich") == 1
    split = wanted.groupBy(F.col("x.contrast").alias("contrast"), level, "seed").agg(
        F.max(F.when(~rich, F.col("regret"))).alias("a"), F.max(F.when(rich, F.col("regret"))).alias("b")
    )
    split = split.withColumn("delta", F.col("a") - F.col("b"))
    counts = split.groupBy("contrast", level).agg(F.count("a").alias("n_poor"), F.count("b").alias("n_rich"))
    stable = sign_stability(split, ["contrast", level], "delta")
    j = counts.join(stable.drop("n_splits", "n_scored"), ["contrast", level])
    scored = (F.col("n_poor") == F.col("n_rich")) & (F.col("n_poor") > 0)
    return j.select("contrast", level, "n_poor", "n_rich", *[F.when(scored, F.col(c)).alias(c) for c in ("mean", "sd", "consistent")])


STRATA = ("task_type", "quartile", "error_quartile", "oracle_action", "tau_sign")


def error_strata(rows: DataFrame, dims: tuple[str, ...] = STRATA) -> DataFrame:
    """Error improvement by each of the given columns, in one grouping-sets pass over merged cells.

    Needs the columns and ``improvement``; rows without an improvement count in n only.
    """
    cells = rows.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("improvement").alias("k"),
        F.sum("improvement").alias("s"),
        F.count_if(F.col("improvement") > 0).alias("up"),
    )
    g = cells.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id().alias("gid"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("up").alias("up")
    )
    full = (1 << len(dims)) - 1
    stratum = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        code = full - (1 << (len(dims) - 1 - i))
        stratum = F.when(F.col("gid") == code, d).otherwise(stratum)
        value = F.when(F.col("gid") == code, F.col(d).cast("string")).otherwise(value)
    return g.select(
        stratum.alias("stratum"), value.alias("value"), "n", (F.col("s") / F.col("k")).alias("mean_improvement"), (F.col("up") / F.col("k")).alias("share_improved")
    )


def transitions(rows: DataFrame) -> DataFrame:
    """Category of each change of decision from policy ``o`` to policy ``a``.

    Needs qc, qi, choice_o, choice_a, err_o, err_a (absolute errors).
    """
    best = best_action(F.col("qc"), F.col("qi"))
    ok_o, ok_a = F.col("choice_o") == best, F.col("choice_a") == best
    cat = (
        F.when(F.col("choice_o").isNull() | F.col("choice_a").isNull(), "unscored")
        .when(F.col("choice_o") == F.col("choice_a"), "unchanged")
        .when(ok_a, "fixed")
        .when(ok_o, "broken")
        .otherwise("wrong_to_wrong")
    )
    qc, qi = F.col("qc"), F.col("qi")
    return rows.withColumns(
        {
            "category": cat,
            "dregret": regret_of(F.col("choice_a"), qc, qi) - regret_of(F.col("choice_o"), qc, qi),
            "dsse": F.col("err_o") * F.col("err_o") - F.col("err_a") * F.col("err_a"),
            "derr": F.col("err_o") - F.col("err_a"),
            "obs_right": ok_o,
            "flip": (~(F.col("choice_o") == F.col("choice_a"))).cast("double"),
        }
    )


def _shares(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Additive regret contribution and share of the squared-error reduction per key."""
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("dregret").alias("sr"),
        F.sum("dsse").alias("ss"),
        F.avg("derr").alias("mean_derr"),
        F.avg("dregret").alias("mean_dregret"),
        F.avg("flip").alias("flip_rate"),
    )
    # The window runs over a handful of category rows.
    every = Window.partitionBy()
    j = g.withColumns({"tn": F.sum("n").over(every), "ts": F.sum("ss").over(every)})
    return j.select(
        *keys,
        "n",
        (F.col("n") / F.col("tn")).alias("share"),
        (F.col("sr") / F.col("tn")).alias("regret_contribution"),
        (F.col("ss") / F.when(F.col("ts") != 0, F.col("ts"))).alias("sse_share"),
        "mean_derr",
        "mean_dregret",
        "flip_rate",
    )


def transition_table(rows: DataFrame) -> DataFrame:
    return _shares(rows, ["category"])


def margin_table(rows: DataFrame) -> DataFrame:
    """The same by margin decile; deciles were fixed over all rows before any split."""
    return _shares(rows, ["decile"])


def subset_table(rows: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """Named, possibly overlapping subsets in one pass, with their share of the error reduction."""
    n, ss = F.count(F.lit(1)), F.sum("dsse")
    aggs = [n.alias("tn"), ss.alias("ts")]
    for name, cond in subsets.items():
        aggs += [
            F.count_if(cond).alias(f"n|{name}"),
            F.sum(F.when(cond, F.col("dsse"))).alias(f"s|{name}"),
            F.avg(F.when(cond, F.col("dregret"))).alias(f"r|{name}"),
        ]
    one = rows.agg(*aggs)
    rec = F.array(
        *[
            F.struct(F.lit(k).alias("subset"), F.col(f"`n|{k}`").alias("n"), F.col(f"`s|{k}`").alias("s"), F.col(f"`r|{k}`").alias("mean_dregret"))
            for k in subsets
        ]
    )
    return one.select("tn", "ts", F.explode(rec).alias("r")).select(
        "r.subset", "r.n", (F.col("r.n") / F.col("tn")).alias("share"), (F.col("r.s") / F.when(F.col("ts") != 0, F.col("ts"))).alias("sse_share"), "r.mean_dregret"
    )


def subset_intervals(rows: DataFrame, subsets: dict[str, Column], cluster: str, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """(subset, sse_share_lo, sse_share_hi, dregret_lo, dregret_hi): whole clusters resampled, all subsets together.

    Rows merge to one table of sums per cluster first, so overlapping subsets share each replicate's weights.
    """
    sums = [F.sum("dsse").alias("ts")]
    for i, cond in enumerate(subsets.values()):
        mine = lambda x: F.sum(F.when(cond, x).otherwise(0.0))  # noqa: B023, E731
        sums += [mine(F.lit(1.0)).alias(f"n{i}"), mine(F.col("dsse")).alias(f"s{i}"), mine(F.col("dregret")).alias(f"r{i}")]
    per = rows.groupBy(cluster).agg(*sums)
    reps = replicate_sums(per, cluster, [c for c in per.columns if c != cluster], None, n_boot, seed)
    cells = [
        F.struct(F.lit(k).alias("subset"), (F.col(f"s{i}") / safe(F.col("ts"))).alias("share"), (F.col(f"r{i}") / safe(F.col(f"n{i}"))).alias("regret"))
        for i, k in enumerate(subsets)
    ]
    long = reps.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    ends = [F.percentile(c, F.lit(p)).alias(f"{name}_{end}") for c, name in (("share", "sse_share"), ("regret", "dregret")) for p, end in ((0.025, "lo"), (0.975, "hi"))]
    return long.groupBy("subset").agg(*ends)


def paired_endpoint(rows: DataFrame, cluster: str, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Mean regret difference with an interval that resamples whole clusters."""
    r = rows.withColumn("grp", F.lit("all"))
    m = r.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("dregret").alias("mean_dregret"))
    return side_by_side([m.drop("grp"), cluster_bootstrap(r, cluster, "dregret", ["grp"], n_boot, seed).drop("grp")])


