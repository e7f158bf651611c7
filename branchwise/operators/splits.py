"""Splits of whole groups and their leakage checks.

All of them work on the group table; labels reach rows by one join on the group.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchwise.functions.ids import order_hash
from branchwise.functions.ordered import hash_numbered

SPLITS = ("train", "val", "test")


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def count_split(rows: DataFrame, group: str, counts: tuple[int, int, int] = (8, 4, 8), seed: int = 0) -> DataFrame:
    """Fill train, val, test to fixed row counts with whole groups in seeded order.

    Of one size only as many groups as could fill all three targets can ever be
    placed, so the ordered fold runs on a few candidates and every other group is
    ``unused`` for certain.
    """
    sizes = group_sizes(rows, group).withColumn("h", order_hash(seed, F.col(group)))
    room = sum((F.floor(F.lit(c) / F.col("size")) for c in counts), F.lit(0))
    w = Window.partitionBy("size").orderBy("h", group)
    ranked = sizes.where(F.col("size") <= max(counts)).withColumn("rn", F.row_number().over(w))
    cand = ranked.where((F.col("rn") <= sum(counts)) & (F.col("rn") <= room))
    packed = cand.agg(F.array_sort(F.collect_list(F.struct("h", F.col(group).alias("g"), "size"))).alias("c"))
    zero = F.lit(0).cast("bigint")
    gtype = dict(rows.dtypes)[group]
    start = F.struct(
        *[zero.alias(s) for s in SPLITS], F.array().cast(f"array<struct<g:{gtype},split:string>>").alias("out")
    )

    def place(acc: Column, item: Column) -> Column:
        fits = [acc[s] + item["size"] <= c for s, c in zip(SPLITS, counts)]
        label = F.when(fits[0], "train").when(fits[1], "val").when(fits[2], "test").otherwise("unused")
        filled = [(acc[s] + F.when(label == s, item["size"]).otherwise(zero)).alias(s) for s in SPLITS]
        row = F.struct(item["g"].alias("g"), label.alias("split"))
        return F.struct(*filled, F.concat(acc["out"], F.array(row)).alias("out"))

    placed = packed.select(F.explode(F.aggregate("c", start, place)["out"]).alias("r")).select(
        F.col("r.g").alias(group), F.col("r.split").alias("split")
    )
    return sizes.join(placed, group, "left").select(group, "size", F.coalesce("split", F.lit("unused")).alias("split"))


def fraction_split(
    rows: DataFrame, group: str, fractions: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: int = 0
) -> DataFrame:
    """Hold out whole groups by share; test takes the remainder."""
    if abs(sum(fractions) - 1.0) > 1e-6:
        raise ValueError(f"fractions must sum to 1.0, got {fractions}")
    ranked = hash_numbered(rows.select(group).distinct(), [], seed, group, "rank", "n_groups")
    n_train = F.bround(F.lit(fractions[0]) * F.col("n_groups"))
    n_val = F.bround(F.lit(fractions[1]) * F.col("n_groups"))
    label = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.select(group, label.alias("split"))


def grouped_holdout(rows: DataFrame, group: str, seeds: list[int], frac: float = 0.30) -> DataFrame:
    """Test flag per (seed, group) for every seed at once; at least one test group."""
    seeded = rows.select(group).distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    ranked = hash_numbered(seeded, ["seed"], F.col("seed"), group, "rank", "n_groups")
    n_test = F.greatest(F.lit(1), F.bround(F.lit(frac) * F.col("n_groups")))
    return ranked.select("seed", group, (F.col("rank") <= n_test).alias("is_test"))


def _fill(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each fold gets when the lightest is always served first.

    The c-th smallest of the keys load + i * size is found by bisection, so a class
    of any multiplicity costs the same.
    """

    def upto(x: int) -> list[int]:
        return [max(0, (x - ld) // size + 1) if x >= ld else 0 for ld in loads]

    lo, hi = min(loads), max(loads) + size * count
    while lo < hi:
        mid = (lo + hi) // 2
        if sum(upto(mid)) >= count:
            hi = mid
        else:
            lo = mid + 1
    got = upto(lo - 1)
    left = count - sum(got)
    for j, ld in enumerate(loads):
        if left and lo >= ld and (lo - ld) % size == 0:
            got[j] += 1
            left -= 1
    return got


def balanced_folds(sizes: DataFrame, keys: list[str], group: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Folds of whole groups with even row counts, largest groups placed first.

    Groups of one size are interchangeable, so the greedy rule runs on the table of
    distinct sizes and hands out rank ranges; ``k`` shrinks to the number of groups.
    """
    classes = sizes.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("m"))

    def assign(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        folds = int(min(k, pdf["m"].sum()))
        loads, out = [0] * folds, []
        for size, m in sorted(zip(pdf["size"], pdf["m"]), reverse=True):
            at = 0
            for f, c in enumerate(_fill(loads, int(size), int(m))):
                if c:
                    out.append((*key, size, f, at + 1, at + c))
                    at += c
                    loads[f] += c * int(size)
        return pd.DataFrame(out, columns=[*keys, "size", "fold", "lo", "hi"])

    kt = ", ".join(f"{c} {t}" for c, t in sizes.dtypes if c in keys)
    schema = f"{kt}{', ' if kt else ''}size bigint, fold int, lo bigint, hi bigint"
    ranges = classes.groupBy(*keys).applyInPandas(assign, schema)
    ranked = hash_numbered(sizes, [*keys, "size"], seed, group, "rank")
    j = ranked.join(ranges, [*keys, "size"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") <= F.col("hi")))
    return j.select(*keys, group, "size", "fold")


def leakage(rows: DataFrame, split: str, group: str) -> DataFrame:
    """Groups that sit in more than one split; unused rows are ignored."""
    used = rows.where(F.coalesce(F.col(split), F.lit("unused")) != "unused")
    per = used.groupBy(group).agg(F.min(split).alias("a"), F.max(split).alias("b"))
    return per.where("a <> b").select(group)


def split_sizes(rows: DataFrame, floors: tuple[int, int] = (100, 40)) -> DataFrame:
    """Train and test rows per seed and whether both reach their floor."""
    return rows.groupBy("seed").agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test")
    ).withColumn("ok", (F.col("n_train") >= floors[0]) & (F.col("n_test") >= floors[1]))


def group_overlap(rows: DataFrame, group: str) -> DataFrame:
    """Share of test rows whose group also occurs in train, per seed."""
    per = rows.groupBy("seed", group).agg(
        F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train")
    )
    return per.groupBy("seed").agg(
        F.sum("n_test").alias("n_test"),
        (F.sum(F.when(F.col("n_train") > 0, F.col("n_test")).otherwise(0)) / F.sum("n_test")).alias("overlap"),
    )


def row_holdout(rows: DataFrame, row_id: str, seeds: list[int], frac: float = 0.30) -> DataFrame:
    """Row-wise split that ignores groups: the leaky scheme the overlap report is about."""
    from branchwise.functions.ids import unit_uniform

    seeded = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return seeded.withColumn("is_test", unit_uniform(F.col("seed"), F.col(row_id)) < frac)


