"""Many logistic models at once: every split, left-out fold, penalty, target and feature block in lockstep.

Rows carry ``z`` = [1, features...], ``folds`` (the fold of every split, -1 test, null or less: not in it) and whole-number
labels. One scan adds up losses and gradients of all models that are still moving; a task keeps one gradient per model.
The Hessian needs no scan: p(1 - p) <= 1/4 (two classes) and diag(p) - pp' <= 1/2 (more) bound it by a multiple of
the fold cross products (``linear.fold_grams``), which are made once. Newton steps with that bound always descend, and a
short history of steps (L-BFGS with the bound as its start) makes them few; a step that does not descend is taken back.
With many rows the first steps are taken on a small sample, which only says where to begin and, by its Hessian there, how
far to step: every model then moves on all rows until its gradient there is as small as without that start.

Coefficients and their history are models x features numbers whatever the rows, so they stay with the driver.
The objective is 0.5 |w|^2 + C * sum of losses on features scaled by the split's train rows, intercepts free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchwise.operators.linear import class_metrics_of_counts, fold_grams, scaler
from branchwise.session import stored

# The inverse-penalty grid of the reference results.
CS = (1e-4, 1e-3, 1e-2, 1e-1, 1e0)
NONE = -9  # the mask that leaves no fold out
TOLERANCE, MAX_STEPS, HISTORY, CHUNK = 1e-10, 200, 6, 512
#: Rows that the first steps are taken on where there are many more; all rows decide where a model ends. A sample's best
#: point is no nearer to that of all rows than its own noise, so it need not be met closely.
START_ROWS, START_TOLERANCE = 20_000, 1e-6


@dataclass
class Models:
    """All models of one block and target: their split, left-out fold and penalty, and where they stand."""

    block: str
    target: str
    cols: list[int]
    classes: int
    split: np.ndarray
    out: np.ndarray
    c: np.ndarray
    scale: np.ndarray  # (models, D, D): raw coefficients = scale @ standardised ones
    inverse: np.ndarray  # (models, D, D): inverse of the Hessian's bound
    rows: np.ndarray
    absent: np.ndarray  # (models, K): 0, or minus infinity for a class that the train rows do not have
    w: np.ndarray = field(init=False)

    def __post_init__(self):
        m, width = len(self.split), 1 if self.classes == 2 else self.classes
        self.w = np.zeros((m, len(self.cols), width))
        self.trial, self.g, self.f = self.w.copy(), np.zeros_like(self.w), np.full(m, np.inf)
        self.steps: list[tuple[np.ndarray, ...]] = []
        self.moving, self.plain = np.ones(m, bool), np.zeros(m, bool)

        self.near: list[tuple[np.ndarray, np.ndarray]] = []

    def again(self, hessians: dict[float, np.ndarray]) -> None:
        """Begin anew at the present point. ``hessians``: by penalty, the mean Hessian of a row's loss near there (raw).

        Models of one penalty and about as many rows share one inverse, in the scale of the first of them. It only shapes
        steps: a step that does not descend is taken back and followed by one of the bound.
        """
        m, d, k = self.w.shape
        self.trial, self.f = self.w.copy(), np.full(m, np.inf)
        self.moving, self.plain, self.steps, self.near = np.ones(m, bool), np.zeros(m, bool), [], []
        size = np.round(np.log(np.maximum(self.rows, 1)) / 0.1).astype(int)
        for c, n in sorted({*zip(self.c.tolist(), size.tolist())}):
            at = np.flatnonzero((self.c == c) & (size == n))
            t, weight = np.kron(self.scale[at[0]], np.eye(k)), c * self.rows[at].mean()
            free = np.repeat(np.array([1e-9 * weight, *[1.0] * (d - 1)]), k)
            self.near.append((at, np.linalg.inv(weight * (t.T @ hessians[c] @ t) + np.diag(free))))

    def bent(self, v: np.ndarray, newton: np.ndarray | None = None) -> np.ndarray:
        """The inverse Hessian that steps start from, times ``v``: the bound's, or the one near the sample's best point."""
        if not self.near:
            return np.matmul(self.inverse, v) if newton is None else newton.copy()
        out = np.zeros_like(v)
        for at, inverse in self.near:
            out[at] = (v[at].reshape(len(at), -1) @ inverse).reshape(len(at), *v.shape[1:])
        return out

    def raw(self, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.scale[at] @ w[at]

    def move(self, loss: np.ndarray, slope: np.ndarray, tolerance: float = TOLERANCE) -> None:
        """Take in the losses and raw gradients at ``trial`` of the moving models and set the next trial."""
        at, live = np.flatnonzero(self.moving), self.moving.copy()
        full = np.zeros_like(self.w)
        full[at] = slope
        free = np.ones((1, len(self.cols), 1))
        free[0, 0] = 0  # the intercept is not penalised
        t = self.trial
        g = self.c[:, None, None] * np.matmul(self.scale.transpose(0, 2, 1), full) + free * t
        f = np.full(len(live), np.inf)
        f[at] = self.c[at] * loss + 0.5 * (free * t * t).sum(axis=(1, 2))[at]
        first = not np.isfinite(self.f).any()
        ok = live & (f <= self.f + 1e-12 * np.abs(np.where(np.isfinite(self.f), self.f, 0)))
        bad = live & ~ok
        mask = ok[:, None, None]
        s, y = np.where(mask, t - self.w, 0), np.where(mask, g - self.g, 0)
        sy = (s * y).sum(axis=(1, 2))
        if not first:
            rho = np.where(sy > 1e-14, 1 / np.where(sy > 1e-14, sy, 1), 0)
            self.steps = [*self.steps, (s, y, rho, self.bent(y))][-HISTORY:]
        self.w, self.g, self.f = np.where(mask, t, self.w), np.where(mask, g, self.g), np.where(ok, f, self.f)
        # A plain step cannot ascend but for rounding: such a model stands at its best.
        self.moving &= ~(bad & self.plain)
        self.plain = np.where(live, bad, self.plain)
        for step in self.steps:
            step[2][bad] = 0
        newton = np.matmul(self.inverse, self.g)
        self.moving &= (self.g * newton).sum(axis=(1, 2)) > tolerance * self.c * self.rows
        self.trial = np.where(self.moving[:, None, None], self.w - self._direction(newton), self.trial)

    def _direction(self, newton: np.ndarray) -> np.ndarray:
        dot = lambda a, b: (a * b).sum(axis=(1, 2))
        # inverse @ (g - sum of a * y) needs no further product: inverse @ y is kept with each step.
        q, r, back = self.g.copy(), self.bent(self.g, newton), []
        for s, y, rho, iy in reversed(self.steps):
            a = rho * dot(s, q)
            q -= a[:, None, None] * y
            r -= a[:, None, None] * iy
            back.append(a)
        if self.steps:
            s, y, rho, iy = self.steps[-1]
            bend = dot(y, iy)
            good = (rho > 0) & (bend > 0)
            r *= np.where(good, 1 / (np.where(good, rho, 1) * np.where(good, bend, 1)), 1.0)[:, None, None]
        for (s, y, rho, _), a in zip(self.steps, reversed(back)):
            r += s * (a - rho * dot(y, r))[:, None, None]
        return np.where(self.plain[:, None, None], newton, r)


def _arrays(batch):
    """(z, folds, labels) of an Arrow batch; a null fold is none."""
    n = batch.num_rows
    z = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    folds = batch.column(1).flatten().fill_null(-2).to_numpy(zero_copy_only=False).reshape(n, -1)
    return z, folds, [c.to_numpy(zero_copy_only=False).astype(int) for c in batch.columns[2:]]


def _scores(z: np.ndarray, cols: list[int], w: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """(rows, models, K) scores of raw coefficients (models, D, K)."""
    s = (z[:, cols] @ w.transpose(1, 0, 2).reshape(len(cols), -1)).reshape(len(z), *w.shape[::2])
    return s if w.shape[2] == 1 else s + absent[None]


def _two(x: np.ndarray, w: np.ndarray, used: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and losses of two-class models, one after the other; passes are in place over a small chunk."""
    s = x @ w[:, :, 0].T
    e = np.exp(-np.abs(s))
    d, up = e + 1, (s > 0).astype(float)
    p = np.maximum(e, up)
    p /= d
    p -= y
    p *= used
    loss = np.log(d)
    loss += s * (up - y)
    loss *= used
    return (x.T @ p)[:, :, None], loss.sum(axis=0)


def _more(x: np.ndarray, w: np.ndarray, used: np.ndarray, y: np.ndarray, absent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with one score per class; an absent class has probability 0."""
    classes = range(w.shape[2])
    s = [x @ w[:, :, k].T + absent[None, :, k] for k in classes]
    top = np.maximum.reduce(s)
    own, total = -top, np.zeros_like(top)
    for k in classes:
        hit = y == k
        own[hit] += s[k][hit]
        s[k] -= top
        np.exp(s[k], out=s[k])
        total += s[k]
    inverse, g = used / total, []
    for k in classes:
        s[k] *= inverse
        s[k] -= used * (y == k)[:, None]
        g.append(x.T @ s[k])
    loss = np.where(used > 0, np.log(total) - own, 0)
    return np.stack(g, axis=2), loss.sum(axis=0)


def _slopes(rows: DataFrame, targets: list[str], models: list[Models]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Losses and raw gradients at the trial points of the moving models, one scan for all."""
    import pyarrow as pa

    tasks = []
    for key, m in enumerate(models):
        at = np.flatnonzero(m.moving)
        if len(at):
            tasks.append((key, targets.index(m.target), m.cols, m.raw(m.trial, at), m.split[at], m.out[at], m.absent[at]))
    # The models of a split, which stand together, see its train rows only, so they go through those alone.
    by_split: dict[int, list[tuple]] = {}
    for i, (_, t, cols, w, split, out, absent) in enumerate(tasks):
        for s in np.unique(split):
            a, b = np.searchsorted(split, [s, s + 1])
            by_split.setdefault(int(s), []).append((i, t, cols, np.ascontiguousarray(w[a:b]), out[a:b], absent[a:b]))

    def run(batches):
        total: dict[int, dict[int, tuple]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            z, folds, labels = _arrays(b)
            for i in range(0, len(z), CHUNK):
                for split, mine in by_split.items():
                    train = i + np.flatnonzero(folds[i : i + CHUNK, split] >= 0)
                    zi, fold = z[train], folds[train, split][:, None]
                    for key, t, cols, w, out, absent in mine:
                        x, y, u = zi[:, cols], labels[t][train], (fold != out[None, :]).astype(float)
                        got = _two(x, w, u, y.astype(float)[:, None]) if w.shape[2] == 1 else _more(x, w, u, y, absent)
                        sums = total.setdefault(key, {}).setdefault(split, got)
                        if sums is not got:
                            for whole, more in zip(sums, got):
                                whole += more
        if total:
            parts = [[np.concatenate(x, axis=axis) for axis, x in zip((1, 0), zip(*map(t.get, sorted(t))))] for t in total.values()]
            parts = [np.concatenate([g.ravel(), loss]).tobytes() for g, loss in parts]
            yield pa.RecordBatch.from_arrays([pa.array([tasks[i][0] for i in total], pa.int32()), pa.array(parts, pa.binary())], ["key", "part"])

    parts = rows.select("z", "folds", *targets).mapInArrow(run, "key int, part binary")
    got = {r["key"]: np.frombuffer(r["part"]) for r in parts.repartition("key").mapInArrow(_add, "key int, part binary").collect()}
    out = {}
    for key, _, cols, w, *_ in tasks:
        m, d, k = w.shape
        v = got.get(key, np.zeros(d * m * k + m))
        out[key] = (v[d * m * k :], v[: d * m * k].reshape(d, m, k).transpose(1, 0, 2))
    return out


def _hessians(rows: DataFrame, targets: list[str], models: list[Models]) -> list[dict[float, np.ndarray]]:
    """Per block and target, by penalty: the mean Hessian of a row's loss at the point of one model of that penalty, in raw
    coefficients. Numbers by models of one split, features squared; ``rows`` are the sample."""
    import pyarrow as pa

    tasks = []
    for key, m in enumerate(models):
        for c in sorted({*m.c.tolist()}):
            at = np.flatnonzero(m.c == c)[-1:]  # the last mask leaves no fold out
            tasks.append((key, c, m.cols, m.raw(m.w, at), m.absent[at]))

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            z = _arrays(b)[0]
            for i, (_, _, cols, w, absent) in enumerate(tasks):
                x, s = z[:, cols], _scores(z, cols, w, absent)[:, 0]
                d, k = len(cols), w.shape[2]
                if k == 1:
                    p = 1 / (1 + np.exp(-s))
                else:
                    p = np.exp(s - s.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                h = np.empty((d, k, d, k))
                for u in range(k):
                    for v in range(u, k):
                        h[:, u, :, v] = h[:, v, :, u] = (x * (p[:, u] * ((u == v) - p[:, v]))[:, None]).T @ x
                both = np.append(h.ravel(), len(x))
                total[i] = total[i] + both if i in total else both
        if total:
            cols = [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "part"])

    parts = rows.select("z", "folds", *targets).mapInArrow(run, "key int, part binary")
    out: list[dict[float, np.ndarray]] = [{} for _ in models]
    for r in parts.repartition("key").mapInArrow(_add, "key int, part binary").collect():
        key, c, cols, w, _ = tasks[r["key"]]
        v = np.frombuffer(r["part"])
        size = len(cols) * w.shape[2]
        out[key][c] = v[:-1].reshape(size, size) / v[-1]
    return out


def _add(batches):
    """Sums of the (key, part) arrays of a task."""
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for b in batches:
        for key, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            v = np.frombuffer(part)
            total[key] = total[key] + v if key in total else v
    cols = [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, ["key", "part"])


def _set_up(rows: DataFrame, blocks: dict, targets: dict[str, int], cs, masks, scale_by) -> list[Models]:
    grams: dict[int, dict[int, np.ndarray]] = {}
    for r in fold_grams(rows.withColumn("folds", F.transform("folds", lambda f: F.coalesce(f, F.lit(-2))))).collect():
        if r["fold"] >= 0:
            d = int(round(len(r["g"]) ** 0.5))
            grams.setdefault(r["seed_ix"], {})[r["fold"]] = np.array(r["g"]).reshape(d, d)
    held = rows.select(F.posexplode("folds").alias("split", "fold"), *targets).where("fold >= 0")
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("y")) for t in targets])
    have: dict[tuple, set] = {}
    for r in held.select("split", "fold", F.explode(pairs).alias("p")).groupBy("split", "fold", "p.target", "p.y").count().collect():
        have.setdefault((r["split"], r["fold"], r["target"]), set()).add(r["y"])
    out = []
    for name, features in blocks.items():
        cols = [0, *features]
        for target, classes in targets.items():
            ix, scale, inverse, n_rows, absent = [], [], [], [], []
            for split, folds in sorted(grams.items()):
                mean, sd = scaler(sum(g for f, g in folds.items() if scale_by is None or f in scale_by), list(features))
                t = np.diag(np.concatenate([[1.0], 1 / sd]))
                t[0, 1:] = -mean / sd
                for left in masks(sorted(folds)):
                    kept = [f for f in folds if f != left]
                    seen = set().union(*[have.get((split, f, target), set()) for f in kept])
                    if len(seen) < 2:
                        continue
                    g = t.T @ sum(folds[f] for f in kept)[np.ix_(cols, cols)] @ t
                    for c in cs:
                        bound = c * (0.25 if classes == 2 else 0.5) * g + np.diag([1e-9 * c * g[0, 0], *[1.0] * len(features)])
                        ix.append((split, left, c))
                        scale.append(t)
                        inverse.append(np.linalg.inv(bound))
                        n_rows.append(g[0, 0])
                        absent.append([0.0 if k in seen else -np.inf for k in range(classes)])
            if ix:
                s, o, c = (np.array(x) for x in zip(*ix))
                out.append(Models(name, target, cols, classes, s, o, c, np.stack(scale), np.stack(inverse), np.array(n_rows), np.array(absent)))
    return out


def _counts(rows: DataFrame, targets: list[str], models: list[Models]) -> DataFrame:
    """(model, target, split, fold, c, label, pred, n): rows scored by the models that did not see them."""
    import pyarrow as pa

    tasks = [(m.block, m.target, targets.index(m.target), m.cols, m.raw(m.w, np.arange(len(m.w))), m.split, m.out, m.c, m.absent, m.classes) for m in models]
    masks = sorted({(int(s), int(o)) for m in models for s, o in zip(m.split, m.out)})

    def run(batches) -> Iterator:
        total: dict[tuple, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            z, folds, labels = _arrays(b)
            for split, left in masks:
                # A row is scored by the models that left its fold out only.
                mine = np.flatnonzero(folds[:, split] == (-1 if left == NONE else left))
                zi = z[mine]
                for block, target, t, cols, w, splits, out, c, absent, classes in tasks:
                    at = np.flatnonzero((splits == split) & (out == left))
                    if not len(at) or not len(mine):
                        continue
                    s = _scores(zi, cols, w[at], absent[at])
                    pred = (s[:, :, 0] > 0).astype(int) if w.shape[2] == 1 else s.argmax(axis=2)
                    cell = (np.arange(len(at))[None, :] * classes + labels[t][mine][:, None]) * classes + pred
                    n = np.bincount(cell.ravel(), minlength=len(at) * classes * classes)
                    for k in np.flatnonzero(n).tolist():
                        j, y, p = at[k // classes**2], k // classes % classes, k % classes
                        key = (block, target, split, -1 if left == NONE else left, float(c[j]), y, p)
                        total[key] = total.get(key, 0) + int(n[k])
        if total:
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64()]
            cols = zip(*[(*k, v) for k, v in total.items()])
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, types)], ["model", "target", "split", "fold", "c", "label", "pred", "n"])

    schema = "model string, target string, split int, fold int, c double, label int, pred int, n long"
    part = rows.select("z", "folds", *targets).mapInArrow(run, schema)
    return part.groupBy("model", "target", "split", "fold", "c", "label", "pred").agg(F.sum("n").alias("n"))


def fit_all(rows: DataFrame, blocks: dict, targets: dict[str, int], cs=CS, masks=None, scale_by=None) -> list[Models]:
    """Every model at its best. ``rows`` is a written table, scanned once per step; ``masks`` gives the folds to leave out
    in turn, and ``scale_by`` the folds that features are scaled by (all, if none)."""
    models = _set_up(rows, blocks, targets, cs, masks or (lambda folds: [*(folds if len(folds) > 1 else []), NONE]), scale_by)
    most, size = max((m.rows.max() for m in models), default=1), START_ROWS
    while size < 0.25 * most:  # each sample begins where a smaller one ended
        share = size / most
        part, size = stored(rows.sample(share, seed=0), "class-start"), 8 * size
        _descend(part, list(targets), models, 1 / share, START_TOLERANCE)
        for m, h in zip(models, _hessians(part, list(targets), models)):
            m.again(h)
    _descend(rows, list(targets), models)
    return models


def _descend(rows: DataFrame, targets: list[str], models: list[Models], weight: float = 1.0, tolerance: float = TOLERANCE) -> None:
    """Move every model to its best on these rows, each of which counts ``weight`` times."""
    for _ in range(MAX_STEPS):
        if not any(m.moving.any() for m in models):
            return
        for key, (loss, slope) in _slopes(rows, targets, models).items():
            models[key].move(weight * loss, weight * slope, tolerance)
    raise RuntimeError("the classifiers did not converge")


def coefficients(spark, models: list[Models]) -> DataFrame:
    """(model, target, split, c, coef) of the models fitted on all train rows, on raw ``z``; one array per class column."""
    out = []
    for m in models:
        at = np.flatnonzero(m.out == NONE)
        for j, w in zip(at.tolist(), m.raw(m.w, at)):
            cols = np.zeros((w.shape[1], max(m.cols) + 1))
            cols[:, m.cols] = w.T
            out.append((m.block, m.target, int(m.split[j]), float(m.c[j]), cols.tolist()))
    return spark.createDataFrame(out, "model string, target string, split int, c double, coef array<array<double>>")


def chosen_scores(rows: DataFrame, targets: list[str], models: list[Models], cs=CS, validation=None) -> DataFrame:
    """(model, target, split, c, n_test, accuracy, macro_f1): each split's penalty by the best mean macro F1 over its
    left-out folds (the smaller C of equals), scored on the test rows. ``validation`` names the folds that choose."""
    counts = _counts(rows, targets, models)
    keys = ["model", "target", "split"]
    scored = class_metrics_of_counts(counts, [*keys, "fold", "c"], "label", "pred", "n")
    held = scored.where("fold >= 0" if validation is None else F.col("fold").isin(list(validation)))
    means = held.groupBy(*keys, "c").agg(F.avg("macro_f1").alias("f1"))
    pick = means.groupBy(*keys).agg(F.max(F.struct("f1", (-F.col("c")).alias("nc"))).alias("b")).select(*keys, (-F.col("b.nc")).alias("c"))
    final = scored.where("fold = -1").withColumnRenamed("n", "n_test").drop("fold")
    # A split without folds takes the middle of the grid.
    kept = final.join(pick.withColumnRenamed("c", "best"), keys, "left").where(F.col("c") == F.coalesce("best", F.lit(cs[len(cs) // 2])))
    return kept.select(*keys, "c", "n_test", "accuracy", "macro_f1")
