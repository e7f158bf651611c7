"""Within-game pairs of checkpoints, without listing them.

A game with m checkpoints has m(m-1)/2 pairs, so pairs are counted or searched,
never enumerated. Progress and value are fixed-point whole numbers (nano units).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from branchwise.functions.ordered import numbered, range_totals, side_by_side
from branchwise.functions.outcomes import nano
from branchwise.session import stored

# The tolerance grid of the feasibility table and the matching rule.
PROGRESS_TOLS = (0.05, 0.10, 0.15, 0.25)
VALUE_GAPS = (0.25, 0.50, 0.75, 1.00)
MATCH_TOL, MATCH_GAP, MIN_PAIRS = 0.15, 0.50, 50
NANO = 1_000_000_000


def nodes(band: DataFrame, id_col: str = "checkpoint_id", game: str = "task_id", rollout: str = "rollout_id") -> DataFrame:
    """Checkpoints of the pinned band with a known progress."""
    return band.where(F.col("progress").isNotNull()).select(
        F.col(id_col).alias("id"),
        F.col(game).alias("game"),
        F.col(rollout).alias("rollout"),
        nano(F.col("progress")).alias("p"),
        nano(F.col("value_intervene")).alias("q"),
        F.col("oracle_action").alias("oracle"),
    )


class RangeWeights:
    """Weight of entries with rank below x inside index ranges, for many queries at once.

    Bit planes of the ranks with prefix sums of weights; memory and time grow with
    n log n, and every query is answered by array operations.
    """

    def __init__(self, ranks: np.ndarray, weight: np.ndarray, n_ranks: int):
        self.bits = max(1, int(n_ranks).bit_length())
        self.planes = []
        r, w = ranks.copy(), weight.astype(float)
        for bit in range(self.bits - 1, -1, -1):
            zero = ((r >> bit) & 1) == 0
            count = np.concatenate([[0], np.cumsum(zero)])
            total = np.concatenate([[0.0], np.cumsum(np.where(zero, w, 0.0))])
            self.planes.append((bit, count, total))
            order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            r, w = r[order], w[order]

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        lo, hi, out = lo.copy(), hi.copy(), np.zeros(len(x))
        for bit, count, total in self.planes:
            one = ((x >> bit) & 1) == 1
            out += np.where(one, total[hi] - total[lo], 0.0)
            nz = count[-1]
            lo = np.where(one, nz + lo - count[lo], count[lo])
            hi = np.where(one, nz + hi - count[hi], count[hi])
        return out


def _halves(cells: DataFrame, keys: list[str], reach: int, block_cells: int) -> DataFrame:
    """Cells as sides of work units: (unit columns ``ba``, ``bb``; ``side`` 0 asks, 1 answers, 2 does both).

    A group's cells in (p, q) order are cut into blocks of ``block_cells``. A unit is one block with itself, or two blocks
    whose progress ranges come within ``reach``, so no unit holds more than two blocks and each pair of cells meets once.
    """
    placed = cells.withColumn("at", F.struct("p", "q")).withColumn("one", F.lit(1).cast("bigint"))
    placed = range_totals(placed, keys, "at", "one", "pair-blocks")
    placed = stored(placed.select(*keys, "p", "q", "w", F.floor((F.col("upto") - 1) / block_cells).alias("blk")), "pair-blocked")
    ends = placed.groupBy(*keys, "blk").agg(F.min("p").alias("p0"), F.max("p").alias("p1"))
    far = ends.select(*keys, F.col("blk").alias("bb"), F.col("p0").alias("far0"))
    near = ends.select(*keys, F.col("blk").alias("ba"), "p1").join(far, keys).where((F.col("ba") < F.col("bb")) & (F.col("far0") - F.col("p1") <= reach))
    ask = near.select(*keys, "ba", "bb", F.col("ba").alias("blk"), F.lit(0).alias("side"))
    answer = near.select(*keys, "ba", "bb", F.col("bb").alias("blk"), F.lit(1).alias("side"))
    own = ends.select(*keys, F.col("blk").alias("ba"), F.col("blk").alias("bb"), "blk", F.lit(2).alias("side"))
    units = ask.unionByName(answer).unionByName(own)
    return placed.join(units, [*keys, "blk"]).select(*keys, "p", "q", "w", "ba", "bb", "side")


def pair_counts(df: DataFrame, keys: list[str], tols=PROGRESS_TOLS, gaps=VALUE_GAPS, bucket_cells: int = 20_000) -> DataFrame:
    """Number of pairs inside each key group under every (tolerance, gap): (tol, gap, n).

    Rows first merge into weighted (group, p, q) cells. Groups of up to ``bucket_cells`` cells share a task by hash bucket
    and are kept apart by an offset on the progress axis. A larger group is cut into blocks along progress, and its
    pairs are counted block against block, so it spreads over tasks however many cells it has. There are as many
    buckets as give each about ``bucket_cells`` cells. A group whose key is null is counted, but never cut.
    """
    steps, seps = [int(round(t * NANO)) for t in tols], [int(round(g * NANO)) for g in gaps]
    cells = stored(df.groupBy(*keys, "p", "q").agg(F.count(F.lit(1)).alias("w")), "pair-cells")
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"))
    most = sizes.agg(F.max("cells")).first()[0] or 0
    whole = [F.lit(0).cast("bigint").alias("ba"), F.lit(0).cast("bigint").alias("bb"), F.lit(2).alias("side")]
    sides = cells.select("*", *whole)
    if most > bucket_cells:
        big = sizes.where(F.col("cells") > bucket_cells).select(*keys)
        small = cells.join(big, keys, "left_anti").select("*", *whole)
        sides = stored(small.unionByName(_halves(cells.join(big, keys, "left_semi"), keys, max(steps), bucket_cells)), "pair-sides")
    buckets = max(16, -(-sides.count() // bucket_cells))
    label = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in [*keys, "ba", "bb"]])
    placed = sides.select(F.pmod(F.xxhash64(*keys, "ba", "bb"), F.lit(buckets)).alias("bucket"), label.alias("label"), "p", "q", "w", "side")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pd.factorize(pdf["label"])[0].astype(np.int64)
        span = int(pdf["p"].max() - pdf["p"].min()) + 2 * max(steps) + 2
        pos = code * span + (pdf["p"].to_numpy() - pdf["p"].min())
        q, w, side = pdf["q"].to_numpy(), pdf["w"].to_numpy().astype(float), pdf["side"].to_numpy()
        there = np.flatnonzero(side != 0)
        there = there[np.argsort(pos[there], kind="stable")]
        asks = np.flatnonzero(side != 1)
        levels, rank = np.unique(q[there], return_inverse=True)
        tree = RangeWeights(rank.astype(np.int64), w[there], len(levels))
        at, qa = pos[asks], q[asks]
        # A unit of one block meets each pair from both ends.
        share = np.where(side[asks] == 2, 1, 2) * w[asks]
        rows = []
        for t, tol in zip(steps, tols):
            lo, hi = np.searchsorted(pos[there], at - t, "left"), np.searchsorted(pos[there], at + t, "right")
            everything = tree.below(lo, hi, np.full(len(qa), len(levels), dtype=np.int64))
            for s, gap in zip(seps, gaps):
                under = tree.below(lo, hi, np.searchsorted(levels, qa - s, "right"))
                over = everything - tree.below(lo, hi, np.searchsorted(levels, qa + s, "left"))
                rows.append((tol, gap, int(round(float(share @ (under + over)) / 2))))
        return pd.DataFrame(rows, columns=["tol", "gap", "n"])

    part = placed.groupBy("bucket").applyInPandas(count, "tol double, gap double, n bigint")
    return part.groupBy("tol", "gap").agg(F.sum("n").alias("n"))


def feasibility_grid(nd: DataFrame) -> DataFrame:
    """Pairs, opposite-action pairs and cross-rollout opposite pairs per threshold pair."""
    grid = ["tol", "gap"]
    every = pair_counts(nd, ["game"]).withColumnRenamed("n", "n_all")
    same = pair_counts(nd, ["game", "oracle"]).withColumnRenamed("n", "n_same")
    inner = pair_counts(nd, ["game", "rollout"]).withColumnRenamed("n", "n_inner")
    inner_same = pair_counts(nd, ["game", "rollout", "oracle"]).withColumnRenamed("n", "n_inner_same")
    j = every.join(same, grid).join(inner, grid).join(inner_same, grid)
    return j.select(
        *grid,
        F.col("n_all").alias("n"),
        (F.col("n_all") - F.col("n_same")).alias("n_opposite"),
        (F.col("n_all") - F.col("n_inner")).alias("n_cross"),
        (F.col("n_all") - F.col("n_same") - F.col("n_inner") + F.col("n_inner_same")).alias("n_cross_opposite"),
    )


def pair_totals(nd: DataFrame) -> DataFrame:
    """Games, games with pairs, all pairs, same-rollout and opposite-action pairs, from group sizes."""

    def within(keys: list[str], out: str) -> DataFrame:
        c = nd.groupBy("game", *keys).agg(F.count(F.lit(1)).cast("bigint").alias("c"))
        return c.agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0)).cast("bigint").alias(out))

    sizes = nd.groupBy("game").agg(F.count(F.lit(1)).alias("c"))
    base = sizes.agg(
        F.count(F.lit(1)).alias("n_games"),
        F.count_if(F.col("c") >= 2).alias("n_games_with_pairs"),
        F.sum(F.when(F.col("c") >= 2, F.col("c")).otherwise(0)).alias("n_rows_in_pairs"),
    )
    j = side_by_side([base, within([], "n_pairs"), within(["rollout"], "n_same_rollout"), within(["oracle"], "same")])
    return j.withColumn("n_opposite", F.col("n_pairs") - F.col("same")).drop("same")


def threshold_choice(grid: DataFrame, gap: float = MATCH_GAP, need: int = MIN_PAIRS) -> DataFrame:
    """Tightest progress tolerance with enough opposite cross-rollout pairs."""
    ok = F.when((F.abs(F.col("gap") - gap) < 1e-9) & (F.col("n_cross_opposite") >= need), F.col("tol"))
    return grid.agg(F.min(ok).alias("tol")).withColumn("supported", F.col("tol").isNotNull())


# ---------------------------------------------------------------- matching


def _equal_progress(nd: DataFrame, sep: int) -> DataFrame:
    """Pairs at progress gap zero that the greedy order takes first.

    Inside one (game, progress) the i-th highest value meets the i-th lowest; this
    holds up to the first pair that is too close or shares a rollout. Positions are
    numbered block-wise and met by equi join, so a large group stays parallel.
    """
    keys = ["game", "p"]
    # Value blocks of about 2^26 nano units are monotone in the sort order.
    up = numbered(nd, keys, F.floor(F.col("q") / 67108864), ["q", "id"], "i").select(
        *keys, "i", F.col("id").alias("lo_id"), F.col("q").alias("lo_q"), F.col("rollout").alias("lo_r")
    )
    down = numbered(nd, keys, F.floor(-F.col("q") / 67108864), [F.col("q").desc(), "id"], "i").select(
        *keys, "i", F.col("id").alias("hi_id"), F.col("q").alias("hi_q"), F.col("rollout").alias("hi_r")
    )
    j = up.join(down, [*keys, "i"]).withColumn("bad", (F.col("hi_q") - F.col("lo_q") < sep) | (F.col("hi_r") == F.col("lo_r")))
    stop = j.where("bad").groupBy(*keys).agg(F.min("i").alias("stop"))
    kept = j.join(stop, keys, "left").where("stop IS NULL OR i < stop")
    return kept.select(
        F.least("lo_id", "hi_id").alias("a"),
        F.greatest("lo_id", "hi_id").alias("b"),
        F.lit(0).cast("bigint").alias("dp"),
        (F.col("hi_q") - F.col("lo_q")).alias("dq"),
    )


def _mutual_best(nd: DataFrame, tol: int, sep: int) -> DataFrame:
    """Edges that are the best remaining edge of both ends.

    For one partner progress only the extreme values can be best, and of each
    extreme only the first two rollouts, so a node meets at most four candidates
    per distinct progress near it.
    """
    best = nd.groupBy("game", "p", "rollout").agg(
        F.min(F.struct((-F.col("q")).alias("k"), F.col("id").alias("id"))).alias("hi"),
        F.min(F.struct(F.col("q").alias("k"), F.col("id").alias("id"))).alias("lo"),
    )
    sides = []
    for side, sign in (("hi", -1), ("lo", 1)):
        w = Window.partitionBy("game", "p").orderBy(f"{side}.k", f"{side}.id")
        top = best.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
        sides.append(
            top.select(
                "game", F.col("p").alias("cp"), F.col("rollout").alias("cr"), (F.col(f"{side}.k") * sign).alias("cq"), F.col(f"{side}.id").alias("cid")
            )
        )
    cand = sides[0].unionByName(sides[1]).distinct()
    block = F.floor(F.col("cp") / tol)
    cand = cand.withColumn("blk", F.explode(F.array(block - 1, block, block + 1)))
    here = nd.withColumn("blk", F.floor(F.col("p") / tol))
    dp, dq = F.abs(F.col("p") - F.col("cp")), F.abs(F.col("q") - F.col("cq"))
    j = here.join(cand, ["game", "blk"]).where((F.col("rollout") != F.col("cr")) & (dp <= tol) & (dq >= sep))
    pick = j.groupBy("id").agg(F.min(F.struct(dp.alias("dp"), (-dq).alias("ndq"), F.col("cid").alias("other"))).alias("e"))
    one = pick.select("id", "e.*")
    back = one.select(F.col("id").alias("other"), F.col("other").alias("id"))
    both = one.join(back, ["id", "other"]).where("id < other")
    return both.select(F.col("id").alias("a"), F.col("other").alias("b"), "dp", (-F.col("ndq")).alias("dq"))


def _in_one_task(nd: DataFrame, tol: int, sep: int) -> DataFrame:
    """The sequential rule itself on games small enough for a task: all edges in order, each taken if both ends are free."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, p, q = pdf["id"].to_numpy(), pdf["p"].to_numpy(), pdf["q"].to_numpy()
        rollout = pd.factorize(pdf["rollout"])[0]
        i, j = np.triu_indices(len(ids), 1)
        dp, dq = np.abs(p[i] - p[j]), np.abs(q[i] - q[j])
        ok = (dp <= tol) & (dq >= sep) & (rollout[i] != rollout[j])
        i, j, dp, dq = i[ok], j[ok], dp[ok], dq[ok]
        taken = []
        order = np.lexsort((j, i, -dq, dp))
        while len(order):
            # A slice is walked edge by edge; what its pairs use up leaves the rest at once.
            used = np.zeros(len(ids), dtype=bool)
            for e in order[:4096]:
                if not (used[i[e]] or used[j[e]]):
                    used[i[e]] = used[j[e]] = True
                    taken.append(e)
            order = order[4096:]
            order = order[~(used[i[order]] | used[j[order]])]
        return pd.DataFrame({"a": ids[i[taken]], "b": ids[j[taken]], "dp": dp[taken], "dq": dq[taken]})

    kind = nd.schema["id"].dataType.simpleString()
    return nd.select("game", "id", "rollout", "p", "q").groupBy("game").applyInPandas(match, f"a {kind}, b {kind}, dp bigint, dq bigint")


def greedy_matching(nd: DataFrame, tol: float = MATCH_TOL, gap: float = MATCH_GAP, task_nodes: int = 1_000) -> DataFrame:
    """Greedy matching without replacement: tightest progress first, then the larger value gap, then the ids.

    Games never share an edge. A game of up to ``task_nodes`` nodes is matched by the sequential rule inside a task. A larger
    one runs in rounds: an edge first in the order at both ends is what the sequential rule would take. Once no more
    than ``task_nodes`` of its nodes can still be matched, a task ends it, so a long tail of competing edges costs one
    job and not a round for each. Each step ends in a written table, so a lost executor repeats one step at
    most. The driver only sees counts. Nodes without a game, progress, value or rollout have no edges.
    """
    t, s = int(round(tol * NANO)), int(round(gap * NANO))
    done, left = [], nd.dropna(subset=["game", "rollout", "p", "q"])
    while True:
        left = stored(left, "nodes")
        sizes = left.groupBy("game").agg(F.count(F.lit(1)).alias("nodes"))
        big = stored(sizes.where(F.col("nodes") > task_nodes).select("game"), "big-games")
        done.append(stored(_in_one_task(left.join(big, "game", "left_anti"), t, s), "matched"))
        if big.isEmpty():
            break
        left = left.join(big, "game", "left_semi")
        found = 0
        for step in (lambda d: _equal_progress(d, s), lambda d: _mutual_best(d, t, s)):
            left = stored(left, "nodes")
            pairs = stored(step(left), "matched")
            n = pairs.count()
            if n:
                found += n
                done.append(pairs)
                left = left.join(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_anti")
        if not found:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def describe_pairs(pairs: DataFrame, nd: DataFrame) -> DataFrame:
    """Add game, whether the best actions differ, and distances in plain units."""
    a = nd.select(F.col("id").alias("a"), "game", F.col("oracle").alias("oa"), F.col("q").alias("qa"))
    b = nd.select(F.col("id").alias("b"), F.col("oracle").alias("ob"), F.col("q").alias("qb"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .select("a", "b", "game", (F.col("dp") / NANO).alias("dprog"), (F.col("dq") / NANO).alias("dq"), (F.col("oa") != F.col("ob")).alias("opposite"), (F.col("qa") > F.col("qb")).alias("a_higher"))
    )


def ranking_accuracy(pairs: DataFrame, predictions: DataFrame, min_pairs: int = 5) -> DataFrame:
    """Share of pairs a score orders as the true values do, per (seed, model).

    ``predictions``: seed, model, id, score on held-out rows. Fewer than
    ``min_pairs`` scorable pairs give null.
    """
    pa = predictions.select("seed", "model", F.col("id").alias("a"), F.col("score").alias("sa"))
    pb = predictions.select("seed", "model", F.col("id").alias("b"), F.col("score").alias("sb"))
    j = pairs.join(pa, "a").join(pb, ["seed", "model", "b"])
    hit = ((F.col("sa") > F.col("sb")) == F.col("a_higher")).cast("double")
    n = F.count(F.lit(1))
    return j.groupBy("seed", "model").agg(n.alias("n_pairs"), F.when(n >= min_pairs, F.avg(hit)).alias("accuracy"))
