"""Ordered computations that stay parallel inside one hot key.

A plain window puts every row of a key into one task. Here a key with many
rows is cut into blocks; windows run per (key, block) and only one small row
per block is ordered per key.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Keys are counted by hash: those of a bucket with more rows than a task should order are cut into blocks.
BUCKETS, TASK_ROWS = 16_384, 262_144


def numbered(
    df: DataFrame, keys: list[str], block: Column, order: list, out: str, total: str | None = None, task_rows: int = TASK_ROWS
) -> DataFrame:
    """1-based position of each row in its key, optionally with the key's row count.

    ``block`` must be monotone in the sort order and cut a key into pieces of a
    size one task can sort (a minute of a week, a hash prefix, ...). Only keys that may have over ``task_rows`` rows are
    cut: counts per hash bucket of the keys tell, which are at most ``BUCKETS`` small rows. Other keys are whole in a task,
    so their rows move once and no block totals are kept for them.
    """
    return _numbered(df, keys, block, order, out, total, _bucket(keys), full_buckets(df, keys, task_rows))


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) if keys else F.lit(0).cast("long")


def full_buckets(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> list[int]:
    """Hash buckets of the keys that hold more rows than a task should order; with none, every key fits a task whole."""
    full = df.groupBy(_bucket(keys).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > task_rows)
    return [r["_bucket"] for r in full.collect()]


def numbered_whole(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """1-based position of each row in its key, where every key fits a task."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def _numbered(df: DataFrame, keys: list[str], block: Column, order: list, out: str, total: str | None, bucket: Column, full: list[int]) -> DataFrame:
    """Positions where the keys of the full buckets, at most rows / task rows of them, are cut into blocks."""
    cut = F.array_contains(F.array(*[F.lit(b) for b in full]).cast("array<bigint>"), bucket)
    tagged = df.withColumn("_block", F.when(cut, block))
    names = [*keys, "_block"]
    whole = Window.partitionBy(*names)
    local = tagged.withColumn("_pos", F.row_number().over(whole.orderBy(*order)).cast("bigint"))
    if total:
        local = local.withColumn("_here", F.count(F.lit(1)).over(whole))
    if not full:
        placed = local.withColumnRenamed("_pos", out).drop("_block")
        return placed.withColumnRenamed("_here", total) if total else placed
    sizes = tagged.where(cut).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total")]
    starts = sizes.select(*names, *cols).toDF(*[f"_s{i}" for i in range(len(names))], "_start", "_total")
    same = [F.col(n).eqNullSafe(F.col(f"_s{i}")) for i, n in enumerate(names)]
    placed = local.join(starts, reduce(lambda a, b: a & b, same), "left")
    placed = placed.withColumn(out, F.col("_pos") + F.coalesce("_start", F.lit(0)))
    if total:
        placed = placed.withColumn(total, F.coalesce("_total", "_here"))
    return placed.drop("_block", "_pos", "_here", "_start", "_total", *[f"_s{i}" for i in range(len(names))])


BLOCK_ROWS = 65_536


def hash_numbered(
    df: DataFrame, keys: list[str], seed, id_col: str, out: str, total: str | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """1-based position in the seeded hash order of an id column.

    Hash prefixes are uniform, so they cut a key into even blocks. How many characters of the prefix are needed follows
    from the largest key's row count: a block holds at most about ``block_rows`` rows, whatever the keys' sizes.
    """
    from branchwise.functions.ids import order_hash

    tagged = df.withColumn("_h", order_hash(seed, F.col(id_col)))
    # One number: the rows of the largest key.
    rows = (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) if keys else df.count()
    length = max(1, math.ceil(math.log(max(rows / block_rows, 1), 16)))
    # Keys that fit a block stay whole; else all are cut, each into as many blocks as it has prefixes.
    none, all_ = F.lit(0).cast("long"), [0] if rows > block_rows else []
    return _numbered(tagged, keys, F.substring("_h", 1, length), ["_h", id_col], out, total, none, all_).drop("_h")


def running_sums(df: DataFrame, keys: list[str], pos: str, sums: dict[str, Column], block_size: int = 1024) -> DataFrame:
    """Inclusive running sums along an integer position, block totals first."""
    tagged = df.withColumn("_block", F.floor(F.col(pos) / block_size))
    names = list(sums)
    totals = tagged.groupBy(*keys, "_block").agg(*[F.sum(sums[n]).alias(n) for n in names])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "_block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b_{n}") for n in names]
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = tagged.select("*", *[F.sum(sums[n]).over(inside).alias(f"_l_{n}") for n in names])
    joined = local.join(starts, [*keys, "_block"])
    for n in names:
        joined = joined.withColumn(n, F.col(f"_l_{n}") + F.col(f"_b_{n}"))
    return joined.drop("_block", *[f"_l_{n}" for n in names], *[f"_b_{n}" for n in names])


def range_totals(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Rows with ``upto``: the key's total weight of values up to and including their own. (keys, value) is unique.

    Rows are dealt in ranges of (keys, value) that Spark cuts from a sample, so their number follows the settings and the
    data; sums inside a range run in one task, and only one total per key and range is ordered per key.
    """
    from branchwise.session import stored

    placed = df.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id())
    placed = stored(placed, name)
    totals = placed.groupBy(*keys, "_part").agg(F.sum(weight).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_upto", F.sum(weight).over(inside))
    return local.join(starts, [*keys, "_part"]).withColumn("upto", F.col("_upto") + F.col("_start")).drop("_part", "_upto", "_start")


def previous(df: DataFrame, keys: list[str], pos: str, cols: list[str], prefix: str = "prev_") -> DataFrame:
    """Values of the row one position earlier, null for the first.

    Positions are dense, so the lag is an equi join on (key, position): it hashes
    on both and spreads a hot key over all tasks.
    """
    earlier = df.select(*keys, (F.col(pos) + 1).alias(pos), *[F.col(c).alias(prefix + c) for c in cols])
    return df.join(earlier, [*keys, pos], "left")


def side_by_side(rows: list[DataFrame]) -> DataFrame:
    """Several one-row results as one row, without joining them."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key: (keys..., prob, quantile)."""
    return exact_positions(df, keys, value, {p: F.lit(float(p)) * (F.col("_n") - 1) for p in probs})


def exact_positions(df: DataFrame, keys: list[str], value: str, positions: dict[float, Column]) -> DataFrame:
    """Values at 0-based sorted positions (columns over the row count ``_n``), by label.

    Labels are the approximate probabilities the sketch should look near.

    A quantile sketch brackets each target rank; one counting pass gives the exact
    rank of every bracket, and only the few rows inside brackets are ordered,
    after equal values are merged. No task sees more than a bracket.

    ``keys`` must name a small set of groups (arms, policies, seeds), which is
    what bounds the broadcast bracket table: one row per group.
    """
    if not keys:
        return _overall_positions(df, value, positions)
    eps, probs = 0.001, list(positions)
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(*keys, v.alias("_v"))
    lows = [max(0.0, p - eps) for p in probs]
    highs = [min(1.0, p + eps) for p in probs]
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", lows + highs, 20000).alias("_cuts"), F.count(F.lit(1)).alias("_n")
    )
    bounds = sketch.select(*keys, "_n", F.array_sort(F.array_distinct("_cuts")).alias("_cuts"))
    # slot = 2 * (cuts below v) + (v equals a cut): monotone in v, so counts per slot give ranks.
    marked = rows.join(F.broadcast(bounds), keys)
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    marked = marked.select(*keys, "_v", (below * 2 + F.array_contains("_cuts", F.col("_v")).cast("int")).alias("_slot"))
    slots = marked.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_start", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    targets = (
        bounds.select(
            *keys,
            "_n",
            F.explode(
                F.array(*[F.struct(F.lit(float(p)).alias("prob"), positions[p].cast("double").alias("_at")) for p in probs])
            ).alias("_t"),
        )
        .select(*keys, "_n", "_t.*")
        .withColumn("_k", F.floor("_at"))
        .select(*keys, "prob", "_at", F.explode(F.array(F.col("_k"), F.least(F.col("_k") + 1, F.col("_n") - 1))).alias("_rank"))
        .distinct()
    )
    hit = (
        targets.join(slots, keys)
        .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_c")))
        .select(*keys, "prob", "_at", "_rank", "_slot", "_start")
    )
    wanted = hit.select(*keys, "_slot").distinct()
    inside = marked.join(F.broadcast(wanted), [*keys, "_slot"], "left_semi")
    merged = inside.groupBy(*keys, "_slot", "_v").agg(F.count(F.lit(1)).alias("_m"))
    within = Window.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumn("_to", F.sum("_m").over(within))
    found = (
        hit.join(ranked, [*keys, "_slot"])
        .where(
            (F.col("_rank") - F.col("_start") < F.col("_to"))
            & (F.col("_rank") - F.col("_start") >= F.col("_to") - F.col("_m"))
        )
        .groupBy(*keys, "prob", "_at")
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    return found.select(
        *keys, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias("quantile")
    )


def _overall_positions(df: DataFrame, value: str, positions: dict[float, Column]) -> DataFrame:
    """The same over the whole table: cut points and slot counts are a few numbers, held as literals."""
    eps, probs = 0.001, list(positions)
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    around = [max(0.0, p - eps) for p in probs] + [min(1.0, p + eps) for p in probs]
    at = [positions[p].cast("double").alias(f"_at{i}") for i, p in enumerate(probs)]
    info = (
        rows.agg(F.percentile_approx("_v", around, 20000).alias("_cuts"), F.count(F.lit(1)).alias("_n")).select("*", *at).first()
    )
    out = "prob double, quantile double"
    if not info["_n"]:
        return df.sparkSession.createDataFrame([], out)
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(info["_cuts"]))])
    slot = F.size(F.filter(cuts, lambda c: c < F.col("_v"))) * 2 + F.array_contains(cuts, F.col("_v")).cast("int")
    marked = rows.select("_v", slot.alias("_slot"))
    start, found = 0, []
    for s, c in sorted((r["_slot"], r["count"]) for r in marked.groupBy("_slot").count().collect()):
        for i, p in enumerate(probs):
            pos = info[f"_at{i}"]
            for k in {math.floor(pos), min(math.floor(pos) + 1, info["_n"] - 1)}:
                if start <= k < start + c:
                    found.append((float(p), float(pos), int(k - start), int(s)))
        start += c
    targets = F.array(
        *[F.struct(F.lit(p).alias("prob"), F.lit(a).alias("at"), F.lit(k).alias("k"), F.lit(s).alias("slot")) for p, a, k, s in found]
    )
    inside = marked.where(F.col("_slot").isin(*{f[3] for f in found}))
    merged = inside.groupBy("_slot", "_v").agg(F.count(F.lit(1)).alias("_m"))
    within = Window.partitionBy("_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = (
        merged.withColumn("_to", F.sum("_m").over(within))
        .withColumn(
            "_t",
            F.filter(
                targets,
                lambda t: (t["slot"] == F.col("_slot")) & (t["k"] < F.col("_to")) & (t["k"] >= F.col("_to") - F.col("_m")),
            ),
        )
        .select("_v", F.explode("_t").alias("_t"))
        .groupBy("_t.prob", "_t.at")
        .agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    )
    return hit.select("prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("quantile"))


def quantile_columns(df: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """Quantiles as one row per key with a column per name."""
    q = exact_quantiles(df, keys, value, sorted(set(named.values())))
    picks = [F.max(F.when(F.abs(F.col("prob") - F.lit(p)) < 1e-12, F.col("quantile"))).alias(n) for n, p in named.items()]
    return q.groupBy(*keys).agg(*picks) if keys else q.agg(*picks)
