"""Centroid clustering with geometrically tightened bounds.

Every vector keeps an upper bound on the distance to its centroid and a lower bound on the distance to any other one.
When centroids move, the plain rule takes the whole drift off each lower bound. Here each cluster is a sphere around
its centroid, and plane geometry in the plane of the sphere's centre and a drifting centroid's two places bounds how much
nearer that centroid can have come to any vector of the sphere: usually less than the drift, often nothing. A vector
whose upper bound stays below its loosened lower bound keeps its cluster unseen; then its own distance is taken, and only
vectors that are still ambiguous are scanned against all centroids, in exact whole numbers.

Vectors lie in packed blocks with their bounds. A round is one pass over the blocks, written below the shared folder; a
block also carries its sums by cluster, so the next centroids come from one narrow column, added up by Spark.

Cases: null vectors, vectors of another length and vectors with a null or non-finite component take no part; a null id
is kept and never starts a centroid before other ids; rows with one id are vectors of their own, equal starts ordered by
their components; fewer vectors than centroids give as many centroids as vectors; equal distances go to the smaller
number; a centroid without vectors stays; an empty table gives an empty result. Components beyond 2**27 raise an error,
because squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import slices
from branchwise.session import stored

CLUSTERS, ROUNDS, SCALE, DIM, SEED, BLOCK_ROWS, LARGEST = 16, 3, 64, 64, 1, 4096, 1 << 27
SAFE = 1e-9  # bounds are widened by this share, far above what rounding can do
BLOCK = (
    "n int, width int, ids binary, nulls binary, points binary, cluster binary, upper binary, lower binary, "
    "sums binary, counts binary, radius binary, scanned long"
)
ROW = "vec_id long, cluster int, distance long, scanned boolean"


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(vec_id, vector) of the vectors that take part."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where((F.size(v) == dim) & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def whole(flat: np.ndarray, scale: int, dim: int) -> np.ndarray:
    """(rows, dim) whole numbers floor(scale * x)."""
    x = np.floor(float(scale) * flat.astype(np.float64)).reshape(-1, dim)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError("components are too large for exact squared distances")
    return x.astype(np.int64)


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(points, centres) exact squared distances."""
    big = max(int(np.abs(points).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4 * points.shape[1] * big * big < 1 << 53:  # every intermediate whole number is exact in a double
        p, c = points.astype(np.float64), centres.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(k, k): how much at most centroid j's distance to a vector of sphere a can have fallen; negative where it grew.

    Seen from the old place c, with drift v of length p, the vectors of the sphere (centre q, radius r) lie within
    asin(r / |q - c|) of the direction to q. The distance to a vector falls at p times the cosine of the angle between
    drift and vector, and that angle only widens on the way, so p * cos(angle(v, q - c) - asin(r / |q - c|)) bounds the
    fall. A second bound is the fall as (|x - c|^2 - |x - c'|^2) / (|x - c| + |x - c'|), both parts taken over the
    sphere. The smaller one holds.
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    drift = new - old
    p = np.sqrt((drift * drift).sum(axis=1))
    out = np.tile(p, (len(old), 1))
    for a, (q, r) in enumerate(zip(old, radius.tolist())):
        to = q - old
        before, after = np.sqrt((to * to).sum(axis=1)), np.sqrt(((q - new) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = np.arccos(np.clip((to * drift).sum(axis=1) / (before * p), -1, 1)) - np.arcsin(np.clip(r / before, 0, 1))
            by_angle = p * np.cos(np.maximum(turn, 0))
            fall = 2 * (((q - (old + new) / 2) * drift).sum(axis=1) + r * p)
            nearest, farthest = before + after - 2 * r, before + after + 2 * r
            by_share = np.where(fall > 0, fall / nearest, fall / farthest)
        outside = (before > r) & (p > 0)
        out[a] = np.where(outside, np.minimum(out[a], by_angle), out[a])
        out[a] = np.where(outside & (nearest > 0), np.minimum(out[a], by_share), out[a])
        out[a] += SAFE * (before + p + r)
    return out


class Bounds:
    """Cluster, upper and lower bound of a block's vectors, moved from one set of centroids to the next."""

    def __init__(self, points: np.ndarray, cluster=None, upper=None, lower=None):
        n = len(points)
        self.points = points
        self.cluster = np.zeros(n, np.uint16) if cluster is None else cluster.copy()
        self.upper = np.full(n, np.inf) if upper is None else upper.copy()
        self.lower = np.zeros(n) if lower is None else lower.copy()
        self.scanned = np.zeros(n, bool)

    def scan(self, rows: np.ndarray, centres: np.ndarray) -> None:
        d = squared(self.points[rows], centres)
        near = d.argmin(axis=1)  # the first of equal ones
        at = np.arange(len(rows))
        self.cluster[rows], self.upper[rows] = near, np.sqrt(d[at, near]) * (1 + SAFE)
        d[at, near] = np.iinfo(np.int64).max
        self.lower[rows] = np.sqrt(d.min(axis=1)) * (1 - SAFE) if len(centres) > 1 else np.inf
        self.scanned[rows] = True

    def own(self, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Exact squared distances to the vectors' own centroids."""
        x = self.points[rows] - centres[self.cluster[rows]]
        return (x * x).sum(axis=1)

    def move(self, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> None:
        loose = loosening(old, new, radius)
        np.fill_diagonal(loose, -np.inf)
        drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + SAFE)
        self.upper += drift[self.cluster]
        if len(old) > 1:
            self.lower = np.maximum(self.lower - loose.max(axis=1)[self.cluster], 0)
        rows = np.flatnonzero(self.upper >= self.lower)
        self.upper[rows] = np.sqrt(self.own(rows, new)) * (1 + SAFE)
        self.scan(rows[self.upper[rows] >= self.lower[rows]], new)


def _packed(points: np.ndarray) -> tuple[int, bytes]:
    """Points in the narrowest whole numbers that hold them."""
    big = int(np.abs(points).max(initial=0))
    width = next(w for w in (1, 2, 4) if big < 1 << (8 * w - 1))
    return width, points.astype(f"<i{width}").tobytes()


def _block(ids: bytes, nulls: bytes, packed: tuple[int, bytes], state: Bounds, k: int) -> list:
    hot = np.zeros((len(state.points), k))
    hot[np.arange(len(hot)), state.cluster] = 1
    sums = (hot.T @ state.points.astype(np.float64)).astype(np.int64)  # a block's sums stay below 2**53
    radius = np.zeros(k)
    np.maximum.at(radius, state.cluster, state.upper)
    parts = [state.cluster, state.upper, state.lower, sums, hot.sum(axis=0).astype(np.int64), radius]
    return [len(hot), packed[0], ids, nulls, packed[1], *[p.tobytes() for p in parts], int(state.scanned.sum())]


def _batch(rows: list[list]):
    import pyarrow as pa

    types = [pa.int32(), pa.int32(), *[pa.binary()] * 9, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in BLOCK.split(", ")])


def _ids(column) -> tuple[bytes, bytes]:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), column.is_null().to_numpy(zero_copy_only=False).tobytes()


def first_pass(rows: DataFrame, centres: np.ndarray, scale: int) -> DataFrame:
    """Blocks of the vectors, each scanned against the first centroids."""
    k, dim = centres.shape

    def run(batches):
        for b in slices(batches, BLOCK_ROWS):
            state = Bounds(whole(b.column(1).flatten().to_numpy(zero_copy_only=False), scale, dim))
            state.scan(np.arange(b.num_rows), centres)
            yield _batch([_block(*_ids(b.column(0)), _packed(state.points), state, k)])

    return stored(rows.mapInArrow(run, BLOCK), "centroid-blocks")


def _unpacked(r: dict, dim: int) -> Bounds:
    points = np.frombuffer(r["points"], f"<i{r['width']}").astype(np.int64).reshape(-1, dim)
    return Bounds(points, np.frombuffer(r["cluster"], np.uint16), np.frombuffer(r["upper"]), np.frombuffer(r["lower"]))


def next_pass(blocks: DataFrame, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> DataFrame:
    """The blocks after the centroids moved."""
    k, dim = new.shape

    def run(batches):
        for b in slices(batches, 8):
            out = []
            for r in b.to_pylist():
                state = _unpacked(r, dim)
                state.move(old, new, radius)
                out.append(_block(r["ids"], r["nulls"], (r["width"], r["points"]), state, k))
            yield _batch(out)

    return stored(blocks.mapInArrow(run, BLOCK), "centroid-blocks")


def last_pass(blocks: DataFrame, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> DataFrame:
    """One row per vector after the centroids moved, with its exact squared distance."""
    import pyarrow as pa

    dim = new.shape[1]

    def run(batches):
        for b in slices(batches, 8):
            for r in b.to_pylist():
                state = _unpacked(r, dim)
                state.move(old, new, radius)
                ids = pa.array(np.frombuffer(r["ids"], np.int64), mask=np.frombuffer(r["nulls"], bool))
                cols = [pa.array(state.cluster.astype(np.int32)), pa.array(state.own(np.arange(r["n"]), new)), pa.array(state.scanned)]
                yield pa.RecordBatch.from_arrays([ids, *cols], ["vec_id", "cluster", "distance", "scanned"])

    return stored(blocks.mapInArrow(run, ROW), "centroid-rows")


def gathered(blocks: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sums, counts, radius, scanned) over all blocks: a task adds up its own, Spark the tasks'; k * (dim + 2) rows in all."""
    import pyarrow as pa

    def run(batches):
        sums, counts, radius, scanned = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k), 0
        for b in batches:
            for r in b.to_pylist():
                sums += np.frombuffer(r["sums"], np.int64).reshape(k, dim)
                counts += np.frombuffer(r["counts"], np.int64)
                radius = np.maximum(radius, np.frombuffer(r["radius"]))
                scanned += r["scanned"]
        cells = np.concatenate([sums.ravel(), counts, [scanned]])
        cols = [pa.array(np.arange(len(cells) + k)), pa.array(np.append(cells, np.zeros(k, np.int64))), pa.array(np.append(np.zeros(len(cells)), radius))]
        yield pa.RecordBatch.from_arrays(cols, ["cell", "total", "most"])

    rows = blocks.select("sums", "counts", "radius", "scanned").mapInArrow(run, "cell long, total long, most double")
    got = {r["cell"]: (r["t"], r["m"]) for r in rows.groupBy("cell").agg(F.sum("total").alias("t"), F.max("most").alias("m")).collect()}
    total = np.array([got[i][0] for i in range(k * dim + k + 1)], np.int64)
    return total[: k * dim].reshape(k, dim), total[k * dim : -1], np.array([got[k * dim + k + 1 + i][1] for i in range(k)]), int(total[-1])


def starts(rows: DataFrame, k: int, scale: int, dim: int, seed: int) -> np.ndarray:
    """The k vectors whose '<seed>:<id>' has the smallest SHA-256, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = rows.orderBy(name.asc_nulls_last(), "vector").limit(k).collect()
    return whole(np.array([x for r in got for x in r["vector"]], np.float64), scale, dim)


def clustered(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    dim: int = DIM,
    seed: int = SEED,
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance, scanned) of every vector that takes part, the last centroids, and how many vectors
    each assignment but the last scanned against all centroids."""
    rows = usable(vectors, id_col, vector_col, dim)
    centres = starts(rows, k, scale, dim, seed)
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], ROW), centres, []
    k, history = len(centres), []
    blocks = first_pass(rows, centres, scale)
    for turn in range(rounds):
        sums, counts, radius, scanned = gathered(blocks, k, dim)
        history.append(scanned)
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centres)
        old, centres = centres, moved
        if turn < rounds - 1:
            blocks = next_pass(blocks, old, centres, radius)
    return last_pass(blocks, old, centres, radius), centres, history


def with_inertia(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with their cluster's and the whole inertia and a digest of their centroid: one small row per cluster joins."""
    per = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(per.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    small = [(j, per[j], total, digest[j]) for j in sorted(per)]
    table = rows.sparkSession.createDataFrame(small, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres, _ = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(rows, centres)


def _round(n: int) -> str:
    """One assignment to centroids c<n> and the centroids after it."""
    return f"""
d{n} AS (SELECT v.vec_id, v.x, c.j, list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v.x[i] - c.c[i]) * (v.x[i] - c.c[i])))::BIGINT AS d
         FROM v, c{n} c),
a{n} AS (SELECT vec_id, x, k % 1000 AS j, k // 1000 AS d
         FROM (SELECT vec_id, any_value(x) AS x, min(d * 1000 + j) AS k FROM d{n} GROUP BY vec_id)),
s{n} AS (SELECT j, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{n}, range(1, {DIM + 1}) r(i) GROUP BY j, i),
c{n + 1} AS (SELECT c.j, coalesce(n.c, c.c) AS c FROM c{n} c LEFT JOIN (SELECT j, list(m ORDER BY i) AS c FROM s{n} GROUP BY j) n ON n.j = c.j)"""


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM}),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x AS c
       FROM (SELECT sha256('{SEED}:' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h LIMIT {CLUSTERS})),
{",".join(_round(n) for n in range(ROUNDS + 1)).strip()}
SELECT a.vec_id, a.j::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.j)::BIGINT AS cluster_inertia,
       sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.j = a.j
"""
