"""Toxicity severity by cumulative-link ordinal regression on sparse term counts.

P(grade >= k) = sigmoid(w.x - theta_k): one weight vector shared by all ordered thresholds. Features are log(1 + count)
of the terms whose document share differs between toxic and other labelled texts (two-proportion z), kept as a sparse
matrix. Labels only say toxic or not, so the grade of a toxic text is made here: 1 plus the number of ``CUTS`` that its count
of positively associated terms reaches (none, mild, strong, severe). Grades above 1 thus follow from the features; what
is learned from labels is the step from 0 to 1. The expected severity is the sum of P(grade >= k).

A text is rejected where P(grade >= 1) reaches the model's cut. The cut is chosen on labelled rows held out of a first fit
(``HELD_OUT``, a hash fold of the sample, terms included): the one with the largest recall of toxic rows less the share of
other rows rejected; between two scores that do equally well, the middle of their log-odds. The model itself is then
fitted on the whole sample. Without held-out rows of both kinds the cut is 0.5.

The fit uses a bounded sample: the ``SAMPLE_ROWS`` labelled ids with the smallest hashes (a parameter), repeated texts
once. Term statistics and fit are of that sample; every row of the table is scored, on its whole text.

Cases: null text is empty and has no terms; rows with null labels are not used; with no labels, or labels of one kind
only, nothing is rejected and severity is 0; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import slices, two_columns
from branchwise.session import stored

SAMPLE_ROWS, LEAST_TEXTS, LEAST_Z, CUTS = 12_000, 8, 6.0, (4, 12)
HELD_OUT, NO_CUT = 5, 0.5  # one fifth of the sample chooses the cut
TERM = re.compile(r"\w+")


def terms(text: str) -> Counter:
    return Counter(TERM.findall(text.lower()))


class Model:
    """Term weights shared by all thresholds, the thresholds in ascending order, and where texts are rejected, with the
    recall and the share of other rows rejected there among held-out rows."""

    def __init__(self, weights: dict[str, float], thresholds: list[float], cut: float = NO_CUT, recall: float | None = None, wrong: float | None = None):
        self.weights, self.thresholds, self.cut, self.recall, self.wrong = weights, thresholds, cut, recall, wrong

    def score(self, counts) -> float:
        return sum(self.weights[t] * math.log1p(n) for t, n in counts.items() if t in self.weights)

    def at_least(self, text: str) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        score = self.score(Counter(t for t in TERM.findall(text.lower()) if t in self.weights))
        return [1.0 / (1.0 + math.exp(min(700.0, max(-700.0, th - score)))) for th in self.thresholds]


def best_cut(odds: list[float], toxic: list[bool]) -> tuple[float, float | None, float | None]:
    """(cut, recall, share of others rejected) over held-out log-odds."""
    order = sorted(zip(odds, toxic), reverse=True)
    n1 = sum(toxic)
    n0 = len(order) - n1
    if not n1 or not n0:
        return NO_CUT, None, None
    best, hit, wrong = (0.0, math.inf, 0.0, 0.0), 0, 0
    for k, (x, t) in enumerate(order):
        hit, wrong = hit + t, wrong + (not t)
        below = order[k + 1][0] if k + 1 < len(order) else x - 1.0
        if below < x and hit / n1 - wrong / n0 > best[0]:
            best = (hit / n1 - wrong / n0, (x + below) / 2, hit / n1, wrong / n0)
    return (1 / (1 + math.exp(-best[1])) if math.isfinite(best[1]) else NO_CUT), best[2], best[3]


def fit_ordinal(
    row: np.ndarray, col: np.ndarray, value: np.ndarray, d: int, grade: np.ndarray, grades: int, l2: float = 1e-3, steps: int = 1500
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that minimise the mean negative log-likelihood plus an L2 term (Adam).

    The (row, col, value) triples are the sparse matrix, ordered by row."""
    n = len(grade)
    ks = np.arange(1, grades)
    start = [math.log(max(1e-6, np.mean(grade < k)) / max(1e-6, np.mean(grade >= k))) for k in ks]
    # thresholds: the first, then logs of the steps up
    free = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    p = np.concatenate([np.zeros(d), free])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        ups = np.exp(p[d + 1 :])
        theta = p[d] + np.concatenate([[0.0], np.cumsum(ups)])
        score = np.bincount(row, value * p[col], n)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -500, 500)))  # P(grade >= k)
        full = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        mass = np.maximum(full[rows, grade] - full[rows, grade + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        lower, upper = slope[rows, grade] / mass, slope[rows, grade + 1] / mass
        d_theta = np.bincount(grade, lower, grades + 1) - np.bincount(grade + 1, upper, grades + 1)
        d_theta = d_theta[1:grades] / n  # of the negative log-likelihood
        d_w = np.bincount(col, value * (upper - lower)[row], d) / n + l2 * p[:d]
        g = np.concatenate([d_w, [d_theta.sum()], [d_theta[i + 1 :].sum() * u for i, u in enumerate(ups)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def telling_terms(sample: DataFrame) -> dict[str, float]:
    """Terms with their z, counted by Spark over the (toxic, text) rows; only terms that pass the screen come back."""
    import pyarrow as pa

    def count(batches):
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for b in slices(batches):
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[bool(toxic)].update(terms(text).keys())
        for toxic, c in enumerate(found):
            cols = [pa.array(list(c.keys()), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["term", "toxic", "n"])

    n1, n0 = sample.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") == 0)).first()
    if not n1 or not n0:
        return {}
    is_toxic = F.col("toxic") == 1
    per = sample.select("toxic", "text").mapInArrow(count, "term string, toxic int, n long")
    per = per.groupBy("term").agg(F.sum(F.when(is_toxic, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(is_toxic, 0).otherwise(F.col("n"))).alias("b"))
    share = (F.col("a") + F.col("b")) / float(n1 + n0)
    sd = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1.0 / n1 + 1.0 / n0))
    z = (F.col("a") / float(n1) - F.col("b") / float(n0)) / sd
    kept = per.where(F.col("a") + F.col("b") >= LEAST_TEXTS).select("term", z.alias("z")).where(F.abs("z") >= LEAST_Z)
    return {r["term"]: r["z"] for r in kept.collect()}


def fit_counts(z: dict[str, float], counts: list[dict], toxic: list[int]) -> Model:
    """The model of labelled texts given as counts of the telling terms."""
    names, y = sorted(z), np.array(toxic, bool)
    hits = np.array([sum(n for t, n in c.items() if z.get(t, 0) > 0) for c in counts])
    grade = np.where(y, 1 + sum((hits >= cut).astype(int) for cut in CUTS), 0)
    # Only grades that occur get thresholds; a grade nobody has would leave its threshold without data.
    seen = sorted(set(grade.tolist()))
    packed = np.searchsorted(seen, grade)
    place = {t: i for i, t in enumerate(names)}
    cells = [(i, place[t], math.log1p(k)) for i, c in enumerate(counts) for t, k in c.items() if t in place]
    row, col, value = (np.array(x) for x in zip(*cells)) if cells else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    w, theta = fit_ordinal(row, col, value, len(names), packed, len(seen))
    full = [theta[np.searchsorted(seen, k) - 1] if k <= seen[-1] else math.inf for k in range(1, len(CUTS) + 2)]
    return Model(dict(zip(names, w.tolist())), [min(t, 1e9) for t in full])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on the sample; the fit itself is one task over the telling terms' counts. None without telling terms."""
    ids = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # At most ``sample_rows`` (id, label) pairs, so their broadcast is bounded.
    sample = docs.join(F.broadcast(ids), "doc_id").groupBy(F.sha2("text", 256).alias("sha")).agg(
        F.max("toxic").alias("toxic"), F.first("text").alias("text")
    )
    held = F.conv(F.substring("sha", 1, 8), 16, 10).cast("long") % HELD_OUT == 0
    sample = stored(sample.select("toxic", "text", held.alias("held")), "toxicity-sample")
    z, first = telling_terms(sample), telling_terms(sample.where("not held"))
    return _solved(sample, z, first) if z else None


def _solved(sample: DataFrame, z: dict[str, float], first: dict[str, float]) -> Model | None:
    """The model on the terms ``z``, its cut from a model of the rows that are not held out on the terms ``first``."""
    import json

    import pyarrow as pa

    wanted = z.keys() | first.keys()

    def count(batches):
        for b in slices(batches):
            rows = [json.dumps({t: n for t, n in terms(x).items() if t in wanted}) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.string())], ["toxic", "held", "counts"])

    def solve(batches):
        toxic, held, counts = [], [], []
        for b in batches:
            toxic += b.column(0).to_pylist()
            held += b.column(1).to_pylist()
            counts += [json.loads(c) for c in b.column(2).to_pylist()]
        out = []
        if counts:
            model, chosen = fit_counts(z, counts, toxic), (NO_CUT, None, None)
            rest = [i for i, h in enumerate(held) if not h]
            if first and rest:
                half = fit_counts(first, [counts[i] for i in rest], [toxic[i] for i in rest])
                mine = [i for i, h in enumerate(held) if h]
                chosen = best_cut([half.score(counts[i]) - half.thresholds[0] for i in mine], [toxic[i] > 0 for i in mine])
            out.append(json.dumps([model.weights, model.thresholds, *chosen]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["model"])

    counted = sample.select("toxic", "held", "text").mapInArrow(count, "toxic int, held boolean, counts string").orderBy("toxic", "counts")
    got = counted.coalesce(1).mapInArrow(solve, "model string").collect()
    return Model(*json.loads(got[0][0])) if got else None


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, rejected) of every row."""
    import pyarrow as pa

    docs = two_columns(docs, id_col, text_col)
    model = fit(docs, labels, sample_rows) or Model({}, [1e9] * (len(CUTS) + 1))

    def run(batches):
        for b in slices(batches):
            p = [model.at_least(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([sum(x) for x in p], pa.float64()), pa.array([sum(q >= 0.5 for q in x) for x in p], pa.int32())]
            cols += [pa.array([x[0] for x in p], pa.float64()), pa.array([x[0] >= model.cut for x in p], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "severity", "grade", "p_toxic", "rejected"])

    return docs.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, rejected boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all their columns unchanged; one pass over the texts."""
    import pyarrow as pa

    model = fit(two_columns(docs, id_col, text_col), labels) or Model({}, [1e9] * (len(CUTS) + 1))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            keep = [model.at_least(t or "")[0] < model.cut for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
