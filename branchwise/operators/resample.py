"""Resampling intervals with hash-derived Poisson weights.

A weight is a pure function of (seed, replicate, row id): a degree-three
polynomial of a 31-bit row hash over the prime 2^31 - 1, cut at the Poisson(1)
distribution function. Rows are never multiplied by replicates: a task keeps one
sum per replicate and emits only those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchwise.functions.ordered import range_totals
from branchwise.session import stored

# The prime and the Poisson(1) distribution function.
PRIME = 2147483647
CDF = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917)
CUTS = tuple(int(c * PRIME) for c in CDF)
N_BOOT = 2000


def row_hash(key: Column) -> Column:
    """31-bit hash of a row id."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % F.lit(PRIME)


def coefficients(seed: int, n_boot: int) -> np.ndarray:
    """Four polynomial coefficients per replicate."""
    out = np.empty((n_boot, 4), dtype=np.int64)
    for r in range(n_boot):
        h = hashlib.md5(f"{seed}|{r}".encode()).hexdigest()
        out[r] = [int(h[8 * i : 8 * i + 8], 16) % PRIME for i in range(4)]
    return out


def weights(h: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """(rows x replicates) Poisson weights."""
    x = h.astype(np.int64)[:, None]
    v = (coef[None, :, 0] * x + coef[None, :, 1]) % PRIME
    v = (v * x + coef[None, :, 2]) % PRIME
    v = (v * x + coef[None, :, 3]) % PRIME
    return np.searchsorted(np.asarray(CUTS), v, side="right").astype(np.float64)


def replicate_sums(
    df: DataFrame, row_id: str, sums: list[str], keys: list[str] | None = None, n_boot: int = N_BOOT, seed: int = 0
) -> DataFrame:
    """(keys..., rep) -> weighted count ``w`` and weighted sum of each column.

    ``keys`` name strata; a task emits strata x replicates rows at most, whatever
    number of rows it read.
    """
    keys = keys or []
    types = dict(df.dtypes)
    kt = "".join(f"{k} {types[k]}, " for k in keys)
    schema = f"{kt}rep int, w double, " + ", ".join(f"{c} double" for c in sums)
    narrow = df.select(*keys, row_hash(F.col(row_id)).alias("_h"), *[F.col(c).cast("double").alias(c) for c in sums])

    def rows_of(acc: dict[tuple, np.ndarray]) -> Iterator[pd.DataFrame]:
        for key, got in acc.items():
            out = pd.DataFrame({k: [v] * n_boot for k, v in zip(keys, key)})
            out["rep"] = np.arange(n_boot, dtype=np.int32)
            for j, c in enumerate(["w", *sums]):
                out[c] = got[:, j]
            yield out

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coef = coefficients(seed, n_boot)
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                vals = np.column_stack([np.ones(len(part)), part[sums].to_numpy(float)])
                h = part["_h"].to_numpy()
                got = np.zeros((n_boot, vals.shape[1]))
                for i in range(0, len(part), 2048):
                    got += weights(h[i : i + 2048], coef).T @ vals[i : i + 2048]
                acc[key] = acc[key] + got if key in acc else got
            if len(acc) > 256:  # many strata: hand the partial sums on, memory stays flat
                yield from rows_of(acc)
                acc = {}
        yield from rows_of(acc)

    part = narrow.mapInPandas(partial, schema)
    return part.groupBy(*keys, "rep").agg(F.sum("w").alias("w"), *[F.sum(c).alias(c) for c in sums])


def interval(reps: DataFrame, keys: list[str], stat: Column) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles of a statistic over replicates.

    The percentile input is one number per replicate.
    """
    s = reps.select(*keys, stat.alias("_s")).where(F.col("_s").isNotNull())
    aggs = [
        F.count(F.lit(1)).alias("n_reps"),
        F.avg("_s").alias("boot_mean"),
        F.percentile("_s", F.lit(0.025)).alias("lo"),
        F.percentile("_s", F.lit(0.975)).alias("hi"),
    ]
    return s.groupBy(*keys).agg(*aggs) if keys else s.agg(*aggs)


def safe(x: Column) -> Column:
    return F.when(x != 0, x)


# Statistics as combinations of weighted sums; callers may pass any other column.
def mean_stat(v: str) -> Column:
    return F.col(v) / safe(F.col("w"))


def r2_stat(y: str, yy: str, se: str) -> Column:
    """R2 from weighted sums of y, y squared and squared error."""
    total = F.col(yy) - F.col(y) * F.col(y) / safe(F.col("w"))
    return 1 - F.col(se) / safe(total)


def row_bootstrap(df: DataFrame, row_id: str, value: str, keys: list[str], n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """Row bootstrap interval of a mean."""
    return interval(replicate_sums(df, row_id, [value], keys, n_boot, seed), keys, mean_stat(value))


def r2_bootstrap(df: DataFrame, row_id: str, y: str, preds: list[str], n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """Intervals of each model's R2 and of every difference to the first model.

    All models share the weights, so differences are paired.
    """
    d = df.withColumns({"_y": F.col(y), "_yy": F.col(y) * F.col(y)})
    d = d.withColumns({f"_se_{p}": (F.col(y) - F.col(p)) * (F.col(y) - F.col(p)) for p in preds})
    reps = replicate_sums(d, row_id, ["_y", "_yy", *[f"_se_{p}" for p in preds]], None, n_boot, seed)
    stats = [F.struct(F.lit(f"r2_{p}").alias("stat"), r2_stat("_y", "_yy", f"_se_{p}").alias("v")) for p in preds]
    first = r2_stat("_y", "_yy", f"_se_{preds[0]}")
    stats += [
        F.struct(F.lit(f"delta_{p}").alias("stat"), (r2_stat("_y", "_yy", f"_se_{p}") - first).alias("v")) for p in preds[1:]
    ]
    long = reps.select(F.explode(F.array(*stats)).alias("s")).select("s.*")
    return interval(long, ["stat"], F.col("v"))


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, keys: list[str], n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """Interval of a mean with whole clusters resampled.

    Rows merge to one (count, sum) per cluster first; replicates only meet those.
    """
    per = df.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("m"), F.sum(value).alias("s"))
    reps = replicate_sums(per, cluster, ["m", "s"], keys, n_boot, seed)
    return interval(reps, keys, F.col("s") / safe(F.col("m")))


def stratified_difference(
    df: DataFrame, row_id: str, cohort: str, stratum: str, values: list[str], reference: str, n_boot: int = N_BOOT, seed: int = 0
) -> DataFrame:
    """Difference of two cohorts within strata, resampled within each cohort.

    Strata with fewer than two resampled rows on a side do not count.
    """
    rows = df.select(row_id, cohort, stratum, *values).where(F.col(stratum).isNotNull())
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    # Strata of many rows are few: at most rows / STRATUM_ROWS; only their sums meet as replicates in a join.
    large = [r[stratum] for r in sizes.where(F.col("_n") > STRATUM_ROWS).select(stratum).collect()]
    inside = F.col(stratum).isin(large)
    parts = _small_strata(rows.where(~inside), row_id, cohort, stratum, values, reference, n_boot, seed)
    if large:
        parts = parts.unionByName(_large_strata(rows.where(inside), row_id, cohort, stratum, values, reference, n_boot, seed))
    per = parts.groupBy("other", "metric", "rep").agg((F.sum("num") / F.sum("den")).alias("diff"))
    return interval(per, ["other", "metric"], F.col("diff")).withColumn("differs", (F.col("lo") > 0) | (F.col("hi") < 0))


STRATUM_ROWS = 65_536


def _small_strata(
    rows: DataFrame, row_id: str, cohort: str, stratum: str, values: list[str], reference: str, n_boot: int, seed: int
) -> DataFrame:
    """(other, metric, rep, num, den): a task adds up the strata dealt to it, so it emits one row per cohort, metric and
    replicate whatever the number of strata."""
    types = dict(rows.dtypes)
    cols = [F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]
    narrow = rows.where(F.col(cohort).isNotNull()).select(F.col(stratum).alias("s"), F.col(cohort).alias("c"), row_hash(F.col(row_id)).alias("h"), *cols)
    dealt = narrow.repartition("s").sortWithinPartitions("s", "c")
    names = [f"v{i}" for i in range(len(values))]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coef, acc, held = coefficients(seed, n_boot), {}, None

        def add(pdf: pd.DataFrame) -> None:
            """Whole strata: their sums per cohort, then each other cohort against the reference."""
            s, c = pdf["s"].to_numpy(), pdf["c"].to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])]))
            vals = [np.ones(len(pdf)), *(pdf[n].to_numpy(float) for n in names)]
            sums = [np.zeros((len(edge), n_boot)) for _ in vals]
            h, cell = pdf["h"].to_numpy(), np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(pdf))))
            for i in range(0, len(pdf), 1024):
                w, k = weights(h[i : i + 1024], coef), cell[i : i + 1024]
                starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                for total, v in zip(sums, vals):
                    total[k[starts]] += np.add.reduceat(w * v[i : i + 1024, None], starts, axis=0)
            ref = {s[e]: j for j, e in enumerate(edge) if c[e] == reference}
            for j, e in enumerate(edge):
                r = ref.get(s[e])
                if r is None or r == j:
                    continue
                wa, wb = sums[0][r], sums[0][j]
                ok = (wa >= 2) & (wb >= 2)
                if not ok.any():
                    continue
                got = acc.setdefault(c[e], [np.zeros((len(values), n_boot)), np.zeros(n_boot), np.zeros(n_boot)])
                a, b = np.where(ok, wa, 1), np.where(ok, wb, 1)
                for m in range(len(values)):
                    got[0][m] += np.where(ok, (wa + wb) * (sums[1 + m][r] / a - sums[1 + m][j] / b), 0)
                got[1] += np.where(ok, wa + wb, 0)
                got[2] += ok

        for pdf in batches:
            pdf = pdf if held is None or not len(held) else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            # The last stratum may go on in the next batch.
            s = pdf["s"].to_numpy()
            cut = int(np.flatnonzero(s != s[-1])[-1]) + 1 if (s != s[-1]).any() else 0
            step = 0
            while step < cut:
                end = min(step + 1024, cut)
                while end < cut and s[end] == s[end - 1]:
                    end += 1
                add(pdf.iloc[step:end])
                step = end
            held = pdf.iloc[cut:]
        if held is not None and len(held):
            add(held)
        for other, (num, den, n) in acc.items():
            at = np.flatnonzero(n)
            for m, name in enumerate(values):
                out = pd.DataFrame({"other": [other] * len(at), "metric": name, "rep": at.astype(np.int32)})
                out["num"], out["den"] = num[m][at], den[at]
                yield out

    return dealt.mapInPandas(run, f"other {types[cohort]}, metric string, rep int, num double, den double")


def _large_strata(
    rows: DataFrame, row_id: str, cohort: str, stratum: str, values: list[str], reference: str, n_boot: int, seed: int
) -> DataFrame:
    """The same rows of strata that no task should hold: their weighted sums per replicate come from all tasks."""
    reps = replicate_sums(rows, row_id, values, [cohort, stratum], n_boot, seed)
    a = reps.where(F.col(cohort) == reference).select(stratum, "rep", F.col("w").alias("wa"), *[F.col(v).alias(f"a_{v}") for v in values])
    b = reps.where(F.col(cohort) != reference).select(
        F.col(cohort).alias("other"), stratum, "rep", F.col("w").alias("wb"), *[F.col(v).alias(f"b_{v}") for v in values]
    )
    j = a.join(b, [stratum, "rep"]).where("wa >= 2 AND wb >= 2")
    cells = F.array(
        *[
            F.struct(
                F.lit(v).alias("metric"),
                ((F.col("wa") + F.col("wb")) * (F.col(f"a_{v}") / F.col("wa") - F.col(f"b_{v}") / F.col("wb"))).alias("num"),
            )
            for v in values
        ]
    )
    long = j.select("other", "rep", (F.col("wa") + F.col("wb")).alias("den"), F.explode(cells).alias("r"))
    return long.select("other", "r.metric", "rep", "r.num", "den")


RANGE_ROWS = 50_000


def _value_ranges(df: DataFrame, value: str, size: int) -> DataFrame:
    """(value, range, salts): values in ascending ranges of about ``size`` rows; a value with more rows is a range of its own
    and its rows may be dealt to several tasks, because among equal values there is no order to keep."""
    cnt = df.groupBy(value).agg(F.count(F.lit(1)).alias("_m"))
    upto = range_totals(cnt, [], value, "_m", "boot-values")
    hot = F.col("_m") > size
    nth = 2 * F.floor((F.col("upto") - F.col("_m")) / size) + hot.cast("int")
    return upto.select(value, nth.cast("bigint").alias("range"), F.when(hot, F.ceil(F.col("_m") / size)).otherwise(1).cast("int").alias("salts"))


def rank_bootstrap(
    df: DataFrame, row_id: str, value: str, label: str | None = None, n_boot: int = N_BOOT, seed: int = 0, size: int = RANGE_ROWS
) -> DataFrame:
    """Row bootstrap intervals of the median of ``value`` (the lower one), or, with a 0/1 ``label``, of its AUROC.

    Neither is a sum, but both come exactly from weighted counts in value order. Rows are dealt in ranges of the value; a
    range keeps its total weight of each label and replicate, and the pairs ordered inside it. Totals of earlier
    ranges complete the AUROC; for the median they tell which range holds it, and only that range is read again.
    """
    ranges = stored(_value_ranges(df, value, size), "boot-ranges")
    y = F.lit(0) if label is None else F.col(label).cast("int")
    rows = df.select(F.col(value).alias("x"), y.alias("y"), row_hash(F.col(row_id)).alias("h")).join(ranges.withColumnRenamed(value, "x"), "x")
    rows = stored(rows.withColumn("salt", F.pmod("h", "salts").cast("int")), "boot-rows")
    coef = coefficients(seed, n_boot)

    def totals(key, pdf):
        pdf = pdf.sort_values("x", kind="stable")
        x, h, y = pdf["x"].to_numpy(), pdf["h"].to_numpy(), pdf["y"].to_numpy()
        ones, zeros, below, pairs = np.zeros(n_boot), np.zeros(n_boot), np.zeros(n_boot), np.zeros(n_boot)
        edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        for a, b in zip(edge, np.append(edge[1:], len(x))):  # one value at a time
            p, n = np.zeros(n_boot), np.zeros(n_boot)
            for i in range(a, b, 2048):
                w = weights(h[i : min(b, i + 2048)], coef)
                hit = y[i : min(b, i + 2048)] == 1
                p, n = p + w[hit].sum(axis=0), n + w[~hit].sum(axis=0)
            pairs += p * (below + n / 2)
            below = below + n
            ones, zeros = ones + p, zeros + n
        out = pd.DataFrame({"rep": np.arange(n_boot, dtype=np.int32), "ones": ones, "zeros": zeros, "pairs": pairs})
        out.insert(0, "range", key[0])
        out["values"] = len(edge)
        return out

    parts = rows.groupBy("range", "salt").applyInPandas(totals, "range bigint, rep int, ones double, zeros double, pairs double, values bigint")
    per = parts.groupBy("range", "rep").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.sum("pairs").alias("pairs"), F.max("values").alias("values"))
    # Among the rows of one value every pair is a tie, also between its salts.
    per = per.withColumn("pairs", F.when(F.col("values") == 1, F.col("ones") * F.col("zeros") / 2).otherwise(F.col("pairs")))
    per = stored(per, "boot-totals")
    # One row per range and replicate is ordered within its replicate.
    before = Window.partitionBy("rep").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    if label is not None:
        full = per.withColumn("under", F.coalesce(F.sum("zeros").over(before), F.lit(0.0)))
        both = full.groupBy("rep").agg((F.sum(F.col("pairs") + F.col("ones") * F.col("under")) / safe(F.sum("ones") * F.sum("zeros"))).alias("stat"))
        return interval(both, [], F.col("stat"))
    full = per.withColumn("under", F.coalesce(F.sum("zeros").over(before), F.lit(0.0)))
    full = full.join(per.groupBy("rep").agg(F.sum("zeros").alias("w")), "rep")
    holds = full.where("w > 0 AND 2 * under < w AND 2 * (under + zeros) >= w").select("range", "rep", (F.col("w") / 2 - F.col("under")).alias("need"))
    holds = stored(holds, "boot-holds")

    def medians(key, rows, asked):
        rows = rows.sort_values("x", kind="stable")
        x, h, out = rows["x"].to_numpy(float), rows["h"].to_numpy(), []
        for a in range(0, len(asked) if len(x) else 0, 64):
            reps, need = asked["rep"].to_numpy()[a : a + 64], asked["need"].to_numpy()[a : a + 64]
            upto = np.cumsum(weights(h, coef[reps]), axis=0)
            out += [(int(r), float(x[np.searchsorted(upto[:, i], need[i])])) for i, r in enumerate(reps)]
        return pd.DataFrame(out, columns=["rep", "stat"])

    # A range of one value needs no second look; the others hold about ``size`` rows.
    alone = ranges.where("salts > 1").select("range", F.col(value).cast("double").alias("stat"))
    done = holds.join(alone, "range").select("rep", "stat")
    open_ = rows.where("salts = 1").join(holds.select("range").distinct(), "range", "left_semi")
    found = open_.groupBy("range").cogroup(holds.groupBy("range")).applyInPandas(medians, "rep int, stat double")
    return interval(done.unionByName(found), [], F.col("stat"))


def cohort_sizes(df: DataFrame, cohort: str, min_cohort: int = 25) -> DataFrame:
    """Cohort sizes, which are compared, and which is the reference (the largest)."""
    s = df.groupBy(cohort).agg(F.count(F.lit(1)).alias("n")).withColumn("compared", F.col("n") >= min_cohort)
    top = s.agg(F.min(F.struct((-F.col("n")).alias("n"), cohort)).alias("r"))
    one = top.select(F.col(f"r.{cohort}").alias(cohort), F.lit(True).alias("is_reference"))
    return s.join(one, cohort, "left").withColumn("is_reference", F.coalesce("is_reference", F.lit(False)))


def compared(df: DataFrame, cohort: str, min_cohort: int = 25) -> tuple[DataFrame, str | None]:
    """Rows of the cohorts large enough to compare, and the reference: the largest one, the first by name among equals.

    There are few cohorts, and one name comes to the driver. Rows without a cohort are not compared.
    """
    sizes = cohort_sizes(df.where(F.col(cohort).isNotNull()), cohort, min_cohort).where("compared")
    ref = sizes.where("is_reference").first()
    return df.join(sizes.select(cohort), cohort, "left_semi"), ref[cohort] if ref else None


def shared_strata(df: DataFrame, cohort: str, stratum: str, reference: str | None) -> DataFrame:
    """Per other cohort: strata it has in common with the reference, and strata of either."""
    cells = df.select(cohort, stratum).distinct()
    mine = cells.where(F.col(cohort) == F.lit(reference)).select(stratum, F.lit(1).alias("ref"))
    other = cells.where(F.col(cohort) != F.lit(reference)).join(mine, stratum, "left")
    per = other.groupBy(F.col(cohort).alias("other")).agg(F.count("ref").alias("n_shared"), F.count(F.lit(1)).alias("n_own"))
    total = mine.agg(F.count(F.lit(1)).alias("n_ref"))  # one row
    return per.join(F.broadcast(total)).select("other", "n_shared", (F.col("n_own") + F.col("n_ref") - F.col("n_shared")).alias("n_strata"))


def composition(df: DataFrame, cohort: str, stratum: str) -> DataFrame:
    """Share of each stratum inside each cohort."""
    per = df.groupBy(cohort, stratum).agg(F.count(F.lit(1)).alias("n"))
    tot = per.groupBy(cohort).agg(F.sum("n").alias("total"))
    return per.join(tot, cohort).select(cohort, stratum, "n", (F.col("n") / F.col("total")).alias("share"))


def sign_stability(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sd and whether all scored splits share a sign; unscorable splits stay null."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_splits"),
        F.count(v).alias("n_scored"),
        F.avg(v).alias("mean"),
        F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("sd"),
        F.coalesce(F.bool_and(v > 0) | F.bool_and(v < 0), F.lit(False)).alias("consistent"),
    )


def null_candidates(stability: DataFrame, tol: float = 0.005) -> DataFrame:
    return stability.where(~F.col("consistent") | (F.abs("mean") < tol))


def size_matched(df: DataFrame, id_col: str, n: int, draws: int = 5) -> DataFrame:
    """``draws`` subsamples of n rows without replacement, in seeded hash order."""
    from branchwise.functions.ordered import hash_numbered

    d = df.select("*", F.explode(F.array(*[F.lit(i) for i in range(draws)])).alias("draw"))
    return hash_numbered(d, ["draw"], F.col("draw"), id_col, "rank").where(F.col("rank") <= n).drop("rank")
