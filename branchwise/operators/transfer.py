"""Transfer of a linear model between two cohorts, from cross products alone.

One scan gives Z'Z by side (the largest cohort or the rest), band and place in every split: the seeds' held-out games of a
side, five game folds of the whole side, five game folds of its rows in shared games with the unseen games as test, and
draws of source rows as many as the other side's shared rows. Fits, R2, RMSE, correlation, calibration lines and refits on
any of these rows are d x d algebra on their sums; only rank correlations go back to rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchwise.functions.ordered import hash_numbered
from branchwise.operators import linear as L
from branchwise.operators.splits import balanced_folds
from branchwise.session import stored

WHOLE, SHARED = 0, 1  # places in the folds after those of the seeds
LEAST_UNSEEN, LEAST_BAND = 30, 50  # fixed values: rows below which a subset has no score


def sided(rows: DataFrame, cohort: str = "cohort") -> tuple[DataFrame, str]:
    """Rows with ``side`` (0 for the largest cohort, 1 for all others) and the largest cohort's name."""
    sizes = rows.groupBy(cohort).agg(F.count(F.lit(1)).alias("n"))
    name = sizes.agg(F.min_by(cohort, F.struct((-F.col("n")).alias("n"), cohort))).first()[0]
    return rows.withColumn("side", (F.col(cohort) != F.lit(name)).cast("int")), name


def with_splits(rows: DataFrame, group: str, seeds: list[int], draws: int, id_col: str) -> DataFrame:
    """Rows with ``shared`` (their game occurs on both sides) and ``folds`` of all splits."""
    games = rows.select(group, "side").distinct().groupBy(group).agg((F.count(F.lit(1)) > 1).alias("shared"))
    rows = stored(rows.join(games, group), "sided")
    sizes = rows.groupBy("side", group, "shared").agg(F.count(F.lit(1)).alias("size"))
    whole = balanced_folds(sizes.select("side", group, "size"), ["side"], group, 5).select("side", group, F.col("fold").alias("whole"))
    shared = balanced_folds(sizes.where("shared").select("side", group, "size"), ["side"], group, 5).select("side", group, F.col("fold").alias("part"))
    held = [L.seed_folds(rows.where(F.col("side") == s), group, seeds).withColumn("side", F.lit(s)) for s in (0, 1)]
    held = held[0].unionByName(held[1]).withColumnRenamed("folds", "held")
    rows = rows.join(whole, ["side", group]).join(shared, ["side", group], "left").join(held, ["side", group])
    # A draw takes as many rows of a side as the other side has in shared games.
    counts = {r["side"]: r["n"] for r in rows.where("shared").groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = F.when(F.col("side") == 0, counts.get(1, 0)).otherwise(counts.get(0, 0))
    ranks = rows.select("side", id_col).withColumn("draw", F.explode(F.array(*[F.lit(d) for d in range(draws)])))
    ranks = hash_numbered(ranks, ["side", "draw"], F.col("draw"), id_col, "rank").where(F.col("rank") <= wanted)
    drawn = ranks.groupBy("side", id_col).agg(F.collect_set("draw").alias("drawn"))
    rows = rows.join(drawn, ["side", id_col], "left")
    picked = [F.when(F.array_contains(F.coalesce("drawn", F.array().cast("array<int>")), F.lit(d)), F.col("whole")).otherwise(-2) for d in range(draws)]
    folds = F.concat("held", F.array("whole", F.coalesce("part", F.lit(-1)), *picked))
    return stored(rows.withColumn("folds", folds).drop("whole", "part", "held", "drawn"), "transfer-rows")


def _line(g: np.ndarray, w: np.ndarray, t: int) -> tuple[float, float, float]:
    """(slope, intercept, correlation) of the target on the prediction."""
    n, sp, sy = g[0, 0], g[0] @ w, g[0, t]
    pp, yy, py = w @ g @ w - sp * sp / n, g[t, t] - sy * sy / n, w @ g[:, t] - sp * sy / n
    if pp <= 0 or yy <= 0:
        return float("nan"), float("nan"), float("nan")
    return py / pp, (sy - py / pp * sp) / n, py / np.sqrt(pp * yy)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-12))


SCORES = (
    "alpha double, n_source bigint, n_dest bigint, n_unseen bigint, n_band bigint, within_r2 double, within_sd double, frozen_r2 double, "
    "degradation double, unseen_r2 double, band_r2 double, cosine double, cosine_raw double, n_refit bigint, refit_r2 double, "
    "frozen_minus_refit double, rmse double, pearson double, slope double, intercept double, recalibrated_r2 double, "
    "size_matched_r2 double, size_matched_sd double, n_draws int, size_matched_minus_refit double, coef array<double>"
)


def study(rows: DataFrame, models: list[L.Model], n_seeds: int, draws: int, band: str) -> DataFrame:
    """One row per (source side, model). ``rows`` come from ``with_splits``; ``band`` names a boolean column."""
    grams = L.fold_grams(rows.withColumn("band", F.col(band)), ["side", "band"])

    def solve(key, pdf):
        d = int(round(len(pdf["g"].iloc[0]) ** 0.5))
        by: dict[tuple, np.ndarray] = {}
        for ix, fold, side, top, g in zip(pdf["seed_ix"], pdf["fold"], pdf["side"], pdf["band"], pdf["g"]):
            by[(int(ix), int(fold), int(side), bool(top))] = np.asarray(g, float).reshape(d, d)
        zero = np.zeros((d, d))

        def parts(ix, side):
            out: dict[int, np.ndarray] = {}
            for (i, fold, s, _), g in by.items():
                if (i, s) == (ix, side) and fold >= -1:
                    out[fold] = out.get(fold, zero) + g
            return out

        def fitted(ix, side, m):
            folds = {f: g for f, g in parts(ix, side).items() if f >= 0}
            return L.fit(folds, m) if folds and sum(folds.values())[0, 0] >= 2 else (None, None)

        def scaled(w, side, m):
            cols = list(m.features)
            return w[cols] * L.scaler(sum(parts(n_seeds + WHOLE, side).values()), cols)[1]

        out = []
        for source in (0, 1):
            dest = 1 - source
            whole, split = parts(n_seeds + WHOLE, dest), parts(n_seeds + SHARED, dest)
            every, unseen = sum(whole.values(), zero), split.get(-1, zero)
            train = sum((g for f, g in split.items() if f >= 0), zero)
            top = sum((g for (i, f, s, b), g in by.items() if i == n_seeds + WHOLE and s == dest and b), zero)
            own = sum(parts(n_seeds + WHOLE, source).values(), zero)
            ok = unseen[0, 0] > LEAST_UNSEEN
            for m in models:
                w, alpha = fitted(n_seeds + WHOLE, source, m)
                other, _ = fitted(n_seeds + WHOLE, dest, m)
                refit, _ = fitted(n_seeds + SHARED, dest, m)
                if w is None or other is None:
                    continue
                score = lambda g, c: L.r2(g, c, m.target) if c is not None and g[0, 0] else float("nan")  # noqa: B023, E731
                within = []
                for s in range(n_seeds):
                    test = parts(s, source).get(-1)
                    c, _ = fitted(s, source, m)
                    if test is not None and c is not None:
                        within.append(score(test, c))
                frozen, new = score(every, w), score(unseen, w) if ok else float("nan")
                again = score(unseen, refit) if ok else float("nan")
                slope, icpt, pearson = _line(unseen, w, m.target) if ok else (float("nan"),) * 3
                recal = float("nan")
                if ok and train[0, 0] > 2:
                    a, b, _ = _line(train, w, m.target)
                    moved = a * w
                    moved[0] += b
                    recal = score(unseen, moved)
                matched = []
                for k in range(draws):
                    c, _ = fitted(n_seeds + 2 + k, source, m)
                    if ok and c is not None:
                        matched.append(score(unseen, c))
                mean, sd = (float(np.mean(matched)), float(np.std(matched))) if matched else (float("nan"),) * 2
                raw = _cosine(w[list(m.features)], refit[list(m.features)]) if refit is not None else float("nan")
                out.append((
                    source, m.name, alpha, int(own[0, 0]), int(every[0, 0]), int(unseen[0, 0]), int(top[0, 0]), float(np.mean(within)) if within else float("nan"),
                    float(np.std(within, ddof=1)) if len(within) > 1 else float("nan"), frozen, float(np.mean(within)) - frozen if within else float("nan"), new,
                    score(top, w) if top[0, 0] > LEAST_BAND else float("nan"), _cosine(scaled(w, source, m), scaled(other, dest, m)), raw, int(train[0, 0]), again,
                    new - again, float(np.sqrt(L.sse(unseen, w, m.target) / unseen[0, 0])) if ok else float("nan"), pearson, slope, icpt, recal, mean, sd,
                    len(matched), mean - again, w,
                ))
        return pd.DataFrame(out, columns=["source", "model", *[c.split()[0] for c in SCORES.split(", ")]])

    # All matrices together are a fixed number of d x d sums, whatever the rows.
    return grams.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, f"source int, model string, {SCORES}")


def rank_correlations(rows: DataFrame, fits: DataFrame, targets: dict[str, str]) -> DataFrame:
    """(source, model, spearman) of the frozen predictions on the other side's unseen games. A model is named target|block."""
    unseen = rows.where(~F.col("shared")).select((1 - F.col("side")).alias("source"), "z", *targets.values())
    p = unseen.join(fits.select("source", "model", "coef"), "source").withColumn("p", L.dot(F.col("z"), F.col("coef")))
    name = F.split("model", r"\|")[0]
    y = F.coalesce(*[F.when(name == t, F.col(c)) for t, c in targets.items()])
    return L.spearman(stored(p.select("source", "model", y.alias("y"), "p"), "transfer-ranks"), ["source", "model"], "y", "p")
