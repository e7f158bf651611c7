"""Ridge models from additive cross-product matrices.

Rows carry one array ``z`` = [1, features..., targets...]. Z'Z per (seed, fold) is
a sum over rows, so one scan gives every fold of every seed; training sets are
sums of folds, and all penalties, nested blocks and targets are sub-matrices.
Only d x d matrices ever leave the row level, and they are solved inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchwise.functions.ordered import range_totals
from branchwise.operators.splits import balanced_folds, grouped_holdout
from branchwise.session import stored

# The penalty grid of the reference results.
ALPHAS = (1e0, 1e1, 1e2, 1e3, 1e4, 1e5, 1e6)
TEST = -1


@dataclass(frozen=True)
class Model:
    """A named ridge model: which positions of ``z`` predict which position."""

    name: str
    features: tuple[int, ...]
    target: int


# ------------------------------------------------------------------- folds


def seed_folds(rows: DataFrame, group: str, seeds: list[int], frac: float = 0.30, k: int = 5) -> DataFrame:
    """Per group one array with its fold for every seed; -1 marks the test set.

    The array has one entry per seed, so rows are joined once for all seeds.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    hold = grouped_holdout(sizes, group, seeds, frac)
    train = hold.where(~F.col("is_test")).join(sizes, group).select("seed", group, "size")
    folds = balanced_folds(train, ["seed"], group, k).select("seed", group, "fold")
    test = hold.where("is_test").select("seed", group, F.lit(TEST).alias("fold"))
    both = folds.unionByName(test)
    ordered = F.array_sort(F.collect_list(F.struct("seed", "fold")))
    return both.groupBy(group).agg(F.transform(ordered, lambda x: x["fold"]).alias("folds"))


# ----------------------------------------------------------- cross products


def fold_grams(rows: DataFrame, extra: list[str] | None = None, salts: int = 32) -> DataFrame:
    """(seed_ix, fold, extra...) -> flattened Z'Z and its width.

    Partial sums are built per task over whole Arrow batches; a hot fold or band
    costs nothing extra because only matrices are shuffled, first to ``salts``
    buckets and then to one row per key.
    """
    extra = extra or []
    types = dict(rows.dtypes)
    key_cols = ["seed_ix", "fold", *extra]
    kt = "seed_ix int, fold int" + "".join(f", {c} {types[c]}" for c in extra)

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.stack(pdf["z"].to_numpy()).astype(float)
            folds = np.stack(pdf["folds"].to_numpy())
            codes, labels = (np.zeros(len(pdf), int), [()])
            if extra:
                idx = pd.MultiIndex.from_frame(pdf[extra])
                codes, uniq = pd.factorize(idx)
                labels = [u if isinstance(u, tuple) else (u,) for u in uniq]
            for s in range(folds.shape[1]):
                for f in np.unique(folds[:, s]):
                    hit = folds[:, s] == f
                    for c in np.unique(codes[hit]):
                        m = hit & (codes == c)
                        g = z[m].T @ z[m]
                        key = (s, int(f), *labels[c])
                        acc[key] = acc[key] + g if key in acc else g
        if acc:
            out = pd.DataFrame(list(acc.keys()), columns=key_cols)
            out["salt"] = TaskContext.get().partitionId() % salts
            out["g"] = [a.ravel() for a in acc.values()]
            yield out

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[[0]][key_cols].copy()
        out["g"] = [np.sum(np.stack(pdf["g"].to_numpy()), axis=0)]
        return out

    narrow = rows.select("z", "folds", *extra)
    part = narrow.mapInPandas(partial, f"{kt}, salt int, g array<double>")
    some = part.groupBy(*key_cols, "salt").applyInPandas(total, f"{kt}, g array<double>")
    return some.groupBy(*key_cols).applyInPandas(total, f"{kt}, g array<double>")


# ------------------------------------------------------------------ solving


def _moments(g: np.ndarray, cols: list[int]) -> tuple[float, np.ndarray]:
    return g[0, 0], g[0, cols] / max(g[0, 0], 1.0)


def scaler(g: np.ndarray, cols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population sd; constant columns keep scale 1."""
    n, mu = _moments(g, cols)
    var = np.maximum(np.diag(g)[cols] / max(n, 1.0) - mu**2, 0.0)
    sd = np.sqrt(var)
    sd[sd <= 1e-9 * np.maximum(1.0, np.abs(mu))] = 1.0
    return mu, sd


def ridge(g: np.ndarray, m: Model, alpha: float, sd: np.ndarray) -> np.ndarray:
    """Coefficients over all of ``z`` (intercept first, zeros elsewhere) for scale ``sd``."""
    cols = list(m.features)
    n, mean = _moments(g, cols)
    ybar = g[0, m.target] / n
    cov = (g[np.ix_(cols, cols)] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    rhs = (g[cols, m.target] - n * mean * ybar) / sd
    w = np.linalg.solve(cov + alpha * np.eye(len(cols)), rhs) / sd
    out = np.zeros(g.shape[0])
    out[cols] = w
    out[0] = ybar - w @ mean
    return out


def sse(g: np.ndarray, coef: np.ndarray, target: int) -> float:
    """Squared error of a fitted model on the rows behind a cross-product matrix."""
    return float(max(g[target, target] - 2 * coef @ g[:, target] + coef @ g @ coef, 0.0))


def sst(g: np.ndarray, target: int) -> float:
    return float(max(g[target, target] - g[0, target] ** 2 / max(g[0, 0], 1.0), 0.0))


def r2(g: np.ndarray, coef: np.ndarray, target: int) -> float:
    total = sst(g, target)
    return 1.0 - sse(g, coef, target) / total if total > 0 else float("nan")


def select_alpha(folds: dict[int, np.ndarray], m: Model, alphas=ALPHAS) -> float:
    """First alpha with the strictly best mean held-out R2; features scaled on all of train."""
    fallback = alphas[len(alphas) // 2]
    if len(folds) < 2:
        return fallback
    whole = sum(folds.values())
    _, sd = scaler(whole, list(m.features))
    best, pick = -np.inf, fallback
    for a in alphas:
        scores = [r2(g, ridge(whole - g, m, a, sd), m.target) for g in folds.values()]
        mean = np.mean(scores)
        if mean > best:
            best, pick = mean, a
    return pick


def fit(folds: dict[int, np.ndarray], m: Model, alpha: float | None = None) -> tuple[np.ndarray, float]:
    whole = sum(folds.values())
    a = select_alpha(folds, m) if alpha is None else alpha
    _, sd = scaler(whole, list(m.features))
    return ridge(whole, m, a, sd), a


def _matrices(pdf: pd.DataFrame) -> tuple[dict[int, np.ndarray], np.ndarray | None]:
    d = int(round(len(pdf["g"].iloc[0]) ** 0.5))
    by: dict[int, np.ndarray] = {}
    for f, g in zip(pdf["fold"], pdf["g"]):
        by[int(f)] = by.get(int(f), 0) + np.asarray(g, float).reshape(d, d)
    return by, by.pop(TEST, None)


FIT_SCHEMA = (
    "model string, fold int, alpha double, n_train bigint, n_test bigint, var_test double, r2 double, coef array<double>"
)


def fit_models(grams: DataFrame, models: list[Model], keys: list[str], oof: bool = False, min_train: int = 2) -> DataFrame:
    """Fit every model per key; with ``oof`` also one fit per left-out fold.

    Row ``fold = -1`` is the model for the test set. Out-of-fold rows pin the
    selected alpha and rescale per fold.
    """
    types = dict(grams.dtypes)
    kt = ", ".join(f"{k} {types[k]}" for k in keys)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        folds, test = _matrices(pdf)
        rows = []
        if folds and sum(folds.values())[0, 0] >= min_train:
            whole = sum(folds.values())
            for m in models:
                coef, a = fit(folds, m)
                n_te = int(test[0, 0]) if test is not None else 0
                var = sst(test, m.target) / n_te if n_te else float("nan")
                score = r2(test, coef, m.target) if n_te else float("nan")
                rows.append((*key, m.name, TEST, a, int(whole[0, 0]), n_te, var, score, coef))
                if oof and len(folds) > 1:
                    for f, g in folds.items():
                        rest = whole - g
                        _, sd = scaler(rest, list(m.features))
                        c = ridge(rest, m, a, sd)
                        rows.append((*key, m.name, f, a, int(rest[0, 0]), int(g[0, 0]), sst(g, m.target) / g[0, 0], r2(g, c, m.target), c))
        cols = [*keys, *[p.split()[0] for p in FIT_SCHEMA.split(", ")]]
        return pd.DataFrame(rows, columns=cols)

    return grams.groupBy(*keys).applyInPandas(solve, f"{kt}, {FIT_SCHEMA}")


# -------------------------------------------------------------- predictions


def dot(z: Column, coef: Column) -> Column:
    return F.aggregate(F.zip_with(z, coef, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def seeded_rows(rows: DataFrame) -> DataFrame:
    """One row per (row, seed) with the fold it has there."""
    return rows.select("*", F.posexplode("folds").alias("seed_ix", "fold")).drop("folds")


def with_predictions(seeded: DataFrame, fits: DataFrame, names: list[str]) -> DataFrame:
    """Prediction columns ``p_<model>``: test rows by the final fit, train rows out of fold.

    The fit table has seeds x folds x models rows of d numbers, independent of the
    row count, so it is broadcast.
    """
    maps = fits.groupBy("seed_ix", "fold").agg(
        F.map_from_entries(F.collect_list(F.struct("model", "coef"))).alias("_coefs")
    )
    j = seeded.join(F.broadcast(maps), ["seed_ix", "fold"], "left")
    preds = {f"p_{n}": dot(F.col("z"), F.element_at(F.col("_coefs"), F.lit(n))) for n in names}
    return j.withColumns(preds).drop("_coefs")


def appended(seeded: DataFrame, cols: list[str]) -> DataFrame:
    """Grow ``z`` by more columns (stacked predictions), one seed per row."""
    z = F.concat("z", F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in cols]))
    return seeded.withColumn("z", z)


def seeded_grams(seeded: DataFrame) -> DataFrame:
    """Cross products of rows already expanded per seed."""
    one = seeded.select("z", F.array("fold").alias("folds"), F.col("seed_ix").alias("sx"))
    g = fold_grams(one, ["sx"])
    return g.drop("seed_ix").withColumnRenamed("sx", "seed_ix")


# ------------------------------------------------------- one-hot group block


#: Means of R2 this close differ by the order in which their sums were added up, not by the penalty.
SAME_SCORE = 1e-12


def best_alpha(cv: DataFrame) -> DataFrame:
    """(seed_ix, alpha): the smallest penalty whose ``cv`` is the best one; scores equal but for rounding are equal."""
    scores = F.collect_list(F.struct("alpha", "cv"))
    top = cv.groupBy("seed_ix").agg(F.max("cv").alias("top"), scores.alias("s"))
    close = F.filter("s", lambda x: F.col("top").isNull() | (x["cv"] >= F.col("top") - SAME_SCORE))
    return top.select("seed_ix", F.array_min(F.transform(close, lambda x: x["alpha"])).alias("alpha"))


def group_ceiling(rows: DataFrame, game: str, y: str, alphas=ALPHAS) -> DataFrame:
    """R2 of a one-hot block over games, without building the wide matrix.

    ``rows`` has seed_ix and fold (-1 = test). With an unpenalised intercept the
    ridge solution is a shrunken mean per game, so counts and sums per
    (seed, fold, game) are enough for every fold and penalty. A game without
    training rows predicts the intercept.
    """
    stats = rows.groupBy("seed_ix", "fold", game).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy")
    )
    stats = stored(stats, "game-stats")  # read five times below
    held = F.array(*[F.lit(h) for h in range(-1, 5)])
    train = (
        stats.where("fold >= 0")
        .select("*", F.explode(held).alias("h"))
        .where("h <> fold")
        .groupBy("seed_ix", "h", game)
        .agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
    )
    scale = stats.where("fold >= 0").groupBy("seed_ix", game).agg(F.sum("n").alias("m"))
    whole = stats.where("fold >= 0").groupBy("seed_ix").agg(F.sum("n").alias("m_all"))
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    share = F.col("m") / F.col("m_all")
    t = (
        train.join(scale, ["seed_ix", game])
        .join(F.broadcast(whole), "seed_ix")
        .select("*", (share * (1 - share)).alias("s2"), F.explode(grid).alias("alpha"))
        .withColumn("s2", F.when(F.col("s2") > 0, F.col("s2")).otherwise(F.lit(1.0)))
        .withColumn("pen", F.col("alpha") * F.col("s2"))
        .withColumn("w", F.col("n") * F.col("pen") / (F.col("n") + F.col("pen")))
    )
    base = t.groupBy("seed_ix", "h", "alpha").agg((F.sum(F.col("w") * F.col("sy") / F.col("n")) / F.sum("w")).alias("b0"))
    # One row per (seed, held-out fold, alpha).
    eff = t.join(F.broadcast(base), ["seed_ix", "h", "alpha"]).select(
        "seed_ix",
        "h",
        "alpha",
        game,
        (F.col("b0") + (F.col("sy") - F.col("n") * F.col("b0")) / (F.col("n") + F.col("pen"))).alias("f"),
    )
    val = stats.withColumnRenamed("fold", "h").select("*", F.explode(grid).alias("alpha"))
    scored = (
        val.join(eff, ["seed_ix", "h", "alpha", game], "left")
        .join(F.broadcast(base), ["seed_ix", "h", "alpha"])
        .withColumn("f", F.coalesce("f", "b0"))
    )
    per = scored.groupBy("seed_ix", "h", "alpha").agg(
        F.sum(F.col("syy") - 2 * F.col("f") * F.col("sy") + F.col("n") * F.col("f") * F.col("f")).alias("sse"),
        F.sum("n").alias("n"),
        (F.sum("syy") - F.sum("sy") * F.sum("sy") / F.sum("n")).alias("sst"),
    )
    per = per.withColumn("r2", 1 - F.col("sse") / F.when(F.col("sst") > 0, F.col("sst")))
    cv = per.where("h >= 0").groupBy("seed_ix", "alpha").agg(F.avg("r2").alias("cv"))
    pick = best_alpha(cv)
    return per.where("h = -1").join(F.broadcast(pick), ["seed_ix", "alpha"]).select("seed_ix", "alpha", "n", "r2")


# ------------------------------------------------------------------ metrics


def regression_metrics(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """R2, RMSE, correlation, slope and intercept of y on p, with n and target variance."""
    e = F.col(y) - F.col(p)
    n = F.count(F.lit(1))
    sst_ = F.var_pop(y) * n
    return df.groupBy(*keys).agg(
        n.alias("n"),
        F.var_pop(y).alias("target_var"),
        (1 - F.sum(e * e) / F.when(sst_ > 0, sst_)).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.corr(y, p).alias("pearson"),
        F.regr_slope(y, p).alias("slope"),
        F.regr_intercept(y, p).alias("intercept"),
    )


def average_ranks(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Mid-ranks of a column per key: equal values merge first, and positions come from range totals."""
    cnt = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_m"))
    ranked = range_totals(cnt, keys, col, "_m", "ranks")
    ranks = ranked.select(*keys, col, (F.col("upto") - (F.col("_m") - 1) / 2.0).alias(out))
    return df.join(ranks, [*keys, col])


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    r = average_ranks(average_ranks(df, keys, a, "_ra"), keys, b, "_rb")
    return r.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("spearman"))


def auroc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve from mid-ranks; null with one class."""
    r = average_ranks(df, keys, score, "_r")
    pos = F.col(label) == 1
    np_, nn = F.count_if(pos), F.count_if(~pos)
    u = F.sum(F.when(pos, F.col("_r"))) - np_ * (np_ + 1) / 2.0
    return r.groupBy(*keys).agg((u / F.when(np_ * nn > 0, np_ * nn)).alias("auroc"))


def class_metrics(df: DataFrame, keys: list[str], label: str, pred: str) -> DataFrame:
    """Accuracy and macro F1 from the confusion table."""
    return class_metrics_of_counts(df.groupBy(*keys, label, pred).agg(F.count(F.lit(1)).alias("n")), keys, label, pred, "n")


def class_metrics_of_counts(conf: DataFrame, keys: list[str], label: str, pred: str, n: str) -> DataFrame:
    """Accuracy and macro F1 of a confusion table (keys, label, pred, count)."""
    sides = F.array(
        F.struct(F.col(label).cast("string").alias("c"), F.col(n).alias("t"), F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col(pred).cast("string").alias("c"), F.lit(0).cast("bigint").alias("t"), F.col(n).alias("p")),
    )
    hit = F.when(F.col(label).cast("string") == F.col(pred).cast("string"), F.col(n)).otherwise(0)
    long = conf.select(*keys, hit.alias("hit"), F.posexplode(sides).alias("side", "s")).select(
        *keys, "s.c", "s.t", "s.p", F.when(F.col("side") == 0, F.col("hit")).otherwise(0).alias("h")
    )
    # The class column must not meet a key of the same name.
    long = long.toDF(*keys, "_class", "t", "p", "h")
    per = long.groupBy(*keys, "_class").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    f1 = 2 * F.col("h") / (F.col("t") + F.col("p"))
    return per.groupBy(*keys).agg(
        F.sum("t").alias("n"), (F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("macro_f1")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two coefficient arrays."""
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
