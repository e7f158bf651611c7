"""Linear value models trained on the decision-focused surrogate loss (``outcomes.spo_plus_loss``).

A whole stack of models, the one of every penalty on all of train included, is trained side by side. Rows are packed once
into blocks of numbers that stay with the executors; a step is one small Spark job whose tasks add up one d x 2 gradient per
model over their blocks, and the driver, which holds nothing but the weights, makes the update.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchwise.functions.outcomes import spo_plus_loss
from branchwise.operators.linear import TEST, dot, fold_grams, scaler
from branchwise.session import stored

# Penalty grid and optimiser settings of the reference results.
LAMBDAS = (1e-4, 1e-3, 1e-2, 1e-1, 1e0, 1e1, 1e2)
RATE, STEPS = 0.01, 2000
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8
#: A task of fewer rows costs more to start than to run; a task of more does not use the cores there are.
ROWS_PER_TASK, BLOCK_ROWS, CHUNK = 8_192, 4_096, 256


@dataclass(frozen=True)
class Job:
    """One model of the stack: its penalty and the fold it leaves out (None = none)."""

    lam: float
    held_out: int | None


@dataclass(frozen=True)
class Scale:
    """Rows, means and deviations of a job's training folds, which standardise its features."""

    n: float
    mean: np.ndarray
    sd: np.ndarray

    def to_raw(self, weights: np.ndarray) -> np.ndarray:
        """Standardised (d, 2) weights, intercept first, as coefficients on raw features."""
        slopes = weights[1:] / self.sd[:, None]
        return np.vstack([weights[:1] - self.mean @ slopes, slopes])

    def gradient(self, raw: np.ndarray) -> np.ndarray:
        """Mean gradient in standardised weights from the summed one in raw coefficients."""
        slopes = (raw[1:] - np.outer(self.mean, raw[0])) / self.sd[:, None]
        return np.vstack([raw[:1], slopes]) / self.n


def pull(predicted: np.ndarray, true: np.ndarray) -> np.ndarray:
    """Direction in which the loss grows: (rows, models, 2) for (rows, models, 2) predictions and (rows, 2) values.

    The loss is a maximum over the three actions minus a linear term, so its slope is twice the difference of two
    indicators: of the action that is best under 2 * predicted - true, and of the action that is truly best. Quitting
    is worth 0; earlier actions win ties.
    """

    return 2.0 * (_best(2 * predicted - true[:, None, :]) - _best(true)[:, None, :])


def _best(values: np.ndarray) -> np.ndarray:
    first, second = values[..., 0], values[..., 1]
    take_first = (first >= second) & (first >= 0)
    return np.stack([take_first, ~take_first & (second >= 0)], axis=-1).astype(float)


class Averaged:
    """Adam whose result is the mean of the weights over the later half of the steps."""

    def __init__(self, shape: tuple[int, ...], rate: float, steps: int):
        self.rate, self.steps, self.done = rate, steps, 0
        self.weights, self.mean = np.zeros(shape), np.zeros(shape)
        self.first, self.second = np.zeros(shape), np.zeros(shape)

    def update(self, gradient: np.ndarray) -> None:
        self.done += 1
        self.first += (1 - BETA1) * (gradient - self.first)
        self.second += (1 - BETA2) * (gradient**2 - self.second)
        size = np.sqrt(self.second / (1 - BETA2**self.done)) + EPS
        self.weights = self.weights - self.rate * self.first / (1 - BETA1**self.done) / size
        late = self.done - self.steps // 2
        if late > 0:
            self.mean += (self.weights - self.mean) / late


def _gradients(x: np.ndarray, truth: np.ndarray, fold: np.ndarray, out: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """(d, jobs, 2) summed raw gradients of a block; ``truth`` holds both values and where each action is truly best.

    Rows of a fold meet only the jobs that train on it, so a block of one fold has no rows to mask.
    """
    total = np.zeros_like(coef)
    for f in np.unique(fold[fold >= 0]):
        mine, used = fold == f, np.flatnonzero(out != f)
        part, k = (x, truth) if mine.all() else (x[mine], truth[mine]), len(used)
        sums = _leading(*part, np.concatenate([2 * coef[:, used, 0].T, 2 * coef[:, used, 1].T]))
        best = part[0].T @ part[1][:, 2:]
        total[:, used] += 2.0 * (np.stack([sums[:k].T, sums[k:].T], axis=2) - best[:, None, :])
    return total


def _leading(x: np.ndarray, truth: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """(2 jobs, d) sums of the rows at which the first, then the second action is best under ``twice`` the predictions."""
    k, total = len(twice) // 2, np.zeros_like(twice)
    # Rows lie along the last axis: a job's numbers are then next to each other.
    values, slopes = np.empty((2, 2 * k, min(CHUNK, len(x))))
    q = np.ascontiguousarray(truth[:, :2].T)
    for i in range(0, len(x), CHUNK):
        xi, qi = x[i : i + CHUNK], q[:, i : i + CHUNK]
        v, slope = np.matmul(twice, xi.T, out=values[:, : len(xi)]), slopes[:, : len(xi)]
        first, second = v[:k], v[k:]
        first -= qi[0]
        second -= qi[1]
        lead = first >= np.maximum(second, 0)
        slope[:k] = lead
        slope[k:] = (second >= 0) > lead
        total += slope @ xi
    return total


def _spans(edges: list[int]) -> Iterator[tuple[int, int]]:
    for a, b in zip(edges, edges[1:]):
        yield from ((i, min(i + BLOCK_ROWS, b)) for i in range(a, b, BLOCK_ROWS))


def _blocks(rows: DataFrame, d: int, targets: tuple[int, int], rows_per_task: int):
    """The train rows as an RDD of (features, truth, folds) blocks, by fold, that stays with the executors."""
    rows = rows.where("fold >= 0")

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values("fold", kind="stable")
            # Blocks end where a fold ends.
            cuts = np.flatnonzero(np.diff(pdf["fold"].to_numpy())) + 1
            for i, j in _spans([0, *cuts, len(pdf)]):
                part = pdf.iloc[i:j]
                z = np.stack(part["z"].to_numpy()).astype(float)
                true = z[:, list(targets)]
                arrays = [z[:, :d], np.concatenate([true, _best(true)], axis=1), part["fold"].to_numpy().astype(np.int32)]
                yield pd.DataFrame([[np.ascontiguousarray(a).tobytes() for a in arrays]], columns=["x", "truth", "fold"])

    def read(r) -> tuple[np.ndarray, ...]:
        fold = np.frombuffer(r["fold"], np.int32)
        return np.frombuffer(r["x"]).reshape(len(fold), d), np.frombuffer(r["truth"]).reshape(len(fold), 4), fold

    tasks = max(1, min(-(-rows.count() // rows_per_task), rows.sparkSession.sparkContext.defaultParallelism))
    packed = rows.select("z", "fold").repartition(tasks).mapInPandas(pack, "x binary, truth binary, fold binary")
    return packed.rdd.map(read).persist(StorageLevel.MEMORY_AND_DISK)


def train_stack(
    rows: DataFrame, d: int, targets: tuple[int, int], jobs: list[Job], scales: list[Scale], steps: int = STEPS, rate: float = RATE,
    rows_per_task: int = ROWS_PER_TASK,
) -> np.ndarray:
    """(jobs, d, 2) raw coefficients of all jobs, from (z, fold) rows."""
    blocks = _blocks(rows, d, targets, rows_per_task)
    out = np.array([-1 if j.held_out is None else j.held_out for j in jobs])
    fit = Averaged((len(jobs), d, 2), rate, steps)
    shrink = np.array([j.lam for j in jobs])[:, None, None] * (np.arange(d) > 0)[None, :, None]
    for _ in range(steps):
        coef = np.stack([s.to_raw(w) for s, w in zip(scales, fit.weights)], axis=1)  # (d, jobs, 2)

        def add(part, coef=coef) -> list[np.ndarray]:
            total = np.zeros_like(coef)
            for x, truth, fold in part:
                total += _gradients(x, truth, fold, out, coef)
            return [total]

        total = np.sum(blocks.mapPartitions(add).collect(), axis=0)
        fit.update(np.stack([s.gradient(total[:, i]) for i, s in enumerate(scales)]) + shrink * fit.weights)
    blocks.unpersist()
    return np.stack([s.to_raw(w) for s, w in zip(scales, fit.mean)])


def with_predictions(rows: DataFrame, coef: np.ndarray, d: int, names: tuple[str, str]) -> DataFrame:
    """Prediction columns from fitted coefficients."""
    z = F.slice("z", 1, d)
    for k, name in enumerate(names):
        rows = rows.withColumn(name, dot(z, F.array(*[F.lit(float(x)) for x in coef[:, k]])))
    return rows


def held_out_losses(rows: DataFrame, d: int, targets: tuple[int, int], jobs: list[Job], coef: np.ndarray) -> dict[float, float]:
    """Mean over folds of the mean loss on each job's left-out fold, per penalty."""
    true = [F.element_at("z", t + 1) for t in targets]
    parts = []
    for fold in sorted({j.held_out for j in jobs}):
        scored, losses = rows.where(F.col("fold") == fold), []
        for i, j in enumerate(jobs):
            if j.held_out == fold:
                scored = with_predictions(scored, coef[i], d, (f"c{i}", f"i{i}"))
                losses.append(F.avg(spo_plus_loss(F.col(f"c{i}"), F.col(f"i{i}"), *true)).alias(str(i)))
        parts.append(scored.agg(*losses).first().asDict())
    found = {int(k): v for p in parts for k, v in p.items()}
    lams = dict.fromkeys(j.lam for j in jobs)
    return {lam: float(np.mean([found[i] for i, j in enumerate(jobs) if j.lam == lam])) for lam in lams}


def fit_cv(
    rows: DataFrame, d: int, targets: tuple[int, int], lambdas=LAMBDAS, steps: int = STEPS
) -> tuple[np.ndarray, float, dict[float, float]]:
    """Penalty by held-out surrogate loss, then a fit on all of train.

    ``rows``: z (features first, d of them with the constant) and fold (-1 = test).
    """
    grams = {}
    for r in fold_grams(rows.select("z", F.array("fold").alias("folds"))).collect():  # one d x d matrix per fold
        k = int(round(len(r["g"]) ** 0.5))
        grams[r["fold"]] = np.asarray(r["g"]).reshape(k, k)
    grams.pop(TEST, None)
    folds = sorted(grams)

    def scale(held_out: int | None) -> Scale:
        g = sum(v for f, v in grams.items() if f != held_out)
        return Scale(g[0, 0], *scaler(g, list(range(1, d))))

    data = stored(rows.select("z", "fold"), "decision-rows")
    pick, scores = lambdas[len(lambdas) // 2], {}
    choose = len(folds) > 1 and len(lambdas) > 1
    # The fits on all of train go along with those that choose among them, so rows are passed over once.
    jobs = [Job(lam, f) for lam in lambdas for f in folds] if choose else []
    final = [Job(lam, None) for lam in (lambdas if choose else [pick])]
    coef = train_stack(data, d, targets, jobs + final, [scale(j.held_out) for j in jobs + final], steps)
    if choose:
        scores = held_out_losses(data, d, targets, jobs, coef)
        pick = min(scores, key=scores.get)
    return coef[len(jobs) + [j.lam for j in final].index(pick)], pick, scores
