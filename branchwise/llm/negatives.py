"""Hard negatives by exact inner products in a residue number system.

Vectors of whole numbers are multiplied modulo several small primes: each residue matrix is centred, so a float32 product
over a bounded number of components is a whole number below 2**24 and exact. The residues of a score are put together
again by Chinese remaindering (mixed radix), with as many primes as the largest possible score needs. Then come the
selections: an anchor's first positives, and for each of them the first negatives inside its score window.

Anchors are a stated query set and are scored against all rows in a grid of (row block, anchor block) cells. A cell is one
group of bounded size on both sides, whatever the labels are; it keeps an anchor's first few rows only, and Spark merges
those of the cells. Scores are made twice, since windows depend on the positives.

Cases: rows with a null label, a null vector or a null or non-finite component take no part; vectors of unequal length are
multiplied over the components both have; a row with a null id is no anchor and comes after equal scores with an id;
repeated rows are rows of their own, but anchors alike in id, label and vector are one anchor, and a row with the anchor's
own id is not its positive; an anchor without a positive or without a row in the window gives no rows; an empty table
gives an empty result. Scores that might not fit a long raise an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from branchwise.llm.common import slices
from branchwise.session import stored

SCALE, POSITIVES, NEGATIVES, WINDOW = 256, 5, 10, (30, 90)
CELL_ROWS, CELL_ANCHORS, TILE = 8192, 2048, 1 << 20
EXACT = 1 << 24  # whole numbers up to here are exact in float32
ROWS = "vec_id long, label long, dim int, vector binary"


def primes_below(n: int) -> list[int]:
    """All primes below n, the largest first."""
    sieve = np.ones(n, bool)
    sieve[:2] = False
    for i in range(2, int(n**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    return np.flatnonzero(sieve)[::-1].tolist()


#: With 64 components, products of residues up to 511 either way still add up exactly.
PRIMES = primes_below(1024)


def moduli(bound: int) -> list[int]:
    """Primes whose product exceeds the number of scores from -bound to bound."""
    out, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact (rows of a, rows of b) inner products of whole-number matrices."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    norm = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max()) for x in (a, b)]
    limit = norm[0] * norm[1] * (1 + 1e-9) + 1
    if limit >= 2.0**62:
        raise ValueError("scores may not fit a long")
    bound, digits, primes = int(limit), [], []
    for p in moduli(bound):
        x, y = _centred(a, p), _centred(b, p)
        step = EXACT // (p // 2) ** 2
        r = np.full((len(a), len(b)), bound % p, np.int64)
        for s in range(0, a.shape[1], step):
            r += (x[:, s : s + step] @ y[:, s : s + step].T).astype(np.int64)
        r %= p
        for q, digit in zip(primes, digits):  # the next mixed-radix digit
            r = (r - digit) * pow(q, -1, p) % p
        digits.append(r)
        primes.append(p)
    out, place = np.zeros((len(a), len(b)), np.uint64), 1
    for p, digit in zip(primes, digits):
        out += digit.astype(np.uint64) * np.uint64(place % (1 << 64))
        place *= p
    return (out - np.uint64(bound)).view(np.int64)


def first_of(scores: np.ndarray, allowed: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row the columns of its n largest allowed scores, equal ones by column."""
    width = scores.shape[1]
    n = min(n, width)
    if not n:
        return [np.zeros(0, np.int64)] * len(scores)
    if np.abs(scores).max(initial=0) < 1 << 46 and width <= 1 << 16:
        key = np.where(allowed, (scores << 16) + (width - 1 - np.arange(width))[None, :], np.iinfo(np.int64).min)
        top = np.argpartition(key, width - n, axis=1)[:, width - n :]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, axis=1), axis=1), axis=1)
    else:
        order = np.argsort(-scores, axis=1, kind="stable")
        top = np.take_along_axis(order, np.argsort(~np.take_along_axis(allowed, order, axis=1), axis=1, kind="stable"), axis=1)[:, :n]
    ok = np.take_along_axis(allowed, top, axis=1)
    return [t[o] for t, o in zip(top, ok)]


def whole_vectors(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label, dim, vector) of the rows that take part; a vector is its floor(scale * x) in 2, 4 or 8 bytes."""
    import pyarrow as pa

    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(label_col).isNotNull() & v.isNotNull() & fine)

    def run(batches):
        for b in slices(batches, 2048):
            lists = b.column(2)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            x = np.floor(float(scale) * flat.astype(np.float64))
            big = np.abs(x).max(initial=0)
            if big >= 2.0**62:
                raise ValueError("components do not fit a long")
            width = next(w for w in (2, 4, 8) if big < 2.0 ** (8 * w - 1))
            raw, ends = x.astype(f"<i{width}").tobytes(), (np.cumsum(sizes) * width).tolist()
            cut = [raw[e - n * width : e] for e, n in zip(ends, sizes.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(cut, pa.binary())], ["vec_id", "label", "dim", "vector"])

    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("vector")).mapInArrow(run, ROWS)


def _matrix(table) -> np.ndarray:
    """The vectors of an Arrow table; shorter ones are filled with zeros."""
    raw, dims = table["vector"].to_pylist(), table["dim"].to_pylist()
    out = np.zeros((len(raw), max(dims, default=0)), np.int64)
    if raw and len({(len(r), d) for r, d in zip(raw, dims)}) == 1:
        return np.frombuffer(b"".join(raw), f"<i{len(raw[0]) // dims[0]}").astype(np.int64).reshape(out.shape) if dims[0] else out
    for i, (r, d) in enumerate(zip(raw, dims)):
        if d:
            out[i, :d] = np.frombuffer(r, f"<i{len(r) // d}")
    return out


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, select, schema: str) -> DataFrame:
    """``select(scores, anchor table, label match, row ids)`` over the grid of row blocks and anchor blocks."""
    import pyarrow as pa

    high, wide = -(-n_rows // CELL_ROWS), -(-n_anchors // CELL_ANCHORS)
    block = lambda n, *more: F.pmod(F.xxhash64("vec_id", "label", *more), F.lit(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumn("r", block(high, "row")).withColumn("a", spread(wide))
    right = anchors.withColumn("a", block(wide, "akey")).withColumn("r", spread(high))
    names, types = [c.split()[0] for c in schema.split(", ")], [{"int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in schema.split(", ")]

    def run(left, right):
        left = left.sort_by([("vec_id", "ascending")])  # nulls last: equal scores go by column
        x, y = _matrix(left), _matrix(right)
        d = min(x.shape[1], y.shape[1])
        ids, labels = left["vec_id"].to_pylist(), left["label"].to_numpy()
        out: list[tuple] = []
        step = max(1, TILE // max(1, len(x)))
        for i in range(0, len(y), step):
            part = right.slice(i, step)
            scores = products(y[i : i + step, :d], x[:, :d])
            out += select(scores, part, part["label"].to_numpy()[:, None] == labels[None, :], ids)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    return left.groupBy("r", "a").cogroup(right.groupBy("r", "a")).applyInArrow(run, schema)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = SCALE,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` tells anchors by their ``vec_id``. Negatives of a positive have between window[0] and window[1] percent of its
    score."""
    low, high = window
    table = whole_vectors(rows, id_col, label_col, vector_col, scale)
    table = stored(table.withColumn("row", F.monotonically_increasing_id()), "negative-rows")  # repeated rows spread too
    asked = table.where(anchor).dropDuplicates(["vec_id", "label", "vector"]).withColumn("akey", F.xxhash64("vec_id", "label", "vector"))
    asked = stored(asked, "negative-anchors")
    n, m = table.count(), asked.count()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not m:
        return rows.sparkSession.createDataFrame([], out)

    def positives(scores, part, same, ids):
        own = np.array([i if i is not None else -1 for i in ids])
        known = np.array([i is not None for i in ids])
        mine = part["vec_id"].to_numpy()
        allowed = same & ~((own[None, :] == mine[:, None]) & known[None, :])
        top = first_of(scores, allowed, n_positives)
        return [(k, ids[c], int(scores[i, c])) for i, (k, t) in enumerate(zip(part["akey"].to_pylist(), top)) for c in t.tolist()]

    found = _cells(table, asked, n, m, positives, "akey long, positive_id long, positive_score long")
    best = Window.partitionBy("akey").orderBy(F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last())
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= n_positives)
    # An anchor's positives are few: one list goes with it.
    lists = found.groupBy("akey").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("positives"))
    armed = stored(asked.join(lists, "akey"), "negative-positives")

    def negatives(scores, part, same, ids):
        out = []
        lists, keys, mine = part["positives"].to_pylist(), part["akey"].to_pylist(), part["vec_id"].to_pylist()
        for k in range(max(map(len, lists), default=0)):
            rows = [i for i, p in enumerate(lists) if k < len(p)]
            score = [lists[i][k]["positive_score"] for i in rows]
            least = np.array([-(-low * s // 100) for s in score], np.int64)[:, None]
            most = np.array([high * s // 100 for s in score], np.int64)[:, None]
            sub = scores[rows]
            top = first_of(sub, ~same[rows] & (sub >= least) & (sub <= most), n_negatives)
            for i, t, s in zip(rows, top, sub):
                p = lists[i][k]
                out += [(keys[i], k + 1, mine[i], p["positive_id"], p["positive_score"], ids[c], int(s[c])) for c in t.tolist()]
        return out

    schema = "akey long, nth int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    got = _cells(table, armed, n, m, negatives, schema)
    best = Window.partitionBy("akey", "nth").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    got = got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    return got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", turned), F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
             list_sum(list_transform(range(1, len(r.x) + 1), lambda i: a.x[i] * r.x[i]))::BIGINT AS score
      FROM v a, v r WHERE a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
 AND {WINDOW[0]} * p.positive_score <= 100 * s.score AND 100 * s.score <= {WINDOW[1]} * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= {NEGATIVES}
"""
