import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchwise.operators import pairs as PR
from branchwise.operators import policies as PO

SCHEMA = "id string, game string, rollout string, p long, q long, oracle string"


def random_nodes(seed, n=60, games=4, p_levels=6, hot=False):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if hot and rnd.random() < 0.5 else f"g{rnd.randrange(games)}"
        out.append((f"n{i:03d}", g, f"{g}r{rnd.randrange(4)}", rnd.randrange(p_levels) * 50_000_000, rnd.randrange(12) * 125_000_000, rnd.choice("cqi")))
    return out


def edges(nodes, tol, gap):
    for a, b in combinations(sorted(nodes), 2):
        if a[1] == b[1]:
            dp, dq = abs(a[3] - b[3]), abs(a[4] - b[4])
            if dp <= tol and dq >= gap:
                yield a, b, dp, dq


@pytest.mark.parametrize("seed", [0, 1])
def test_counts_equal_brute_force(spark, seed):
    nodes = random_nodes(seed, 80, hot=True)
    got = {(r["tol"], r["gap"]): r for r in PR.feasibility_grid(spark.createDataFrame(nodes, SCHEMA)).collect()}
    for tol in PR.PROGRESS_TOLS:
        for gap in PR.VALUE_GAPS:
            es = list(edges(nodes, round(tol * 1e9), round(gap * 1e9)))
            r = got[(tol, gap)]
            assert r["n"] == len(es)
            assert r["n_opposite"] == sum(a[5] != b[5] for a, b, *_ in es)
            assert r["n_cross"] == sum(a[2] != b[2] for a, b, *_ in es)
            assert r["n_cross_opposite"] == sum(a[2] != b[2] and a[5] != b[5] for a, b, *_ in es)


@pytest.mark.parametrize("seed, block", [(0, 3), (1, 7), (2, 20)])
def test_a_large_game_is_counted_block_against_block(spark, seed, block):
    nodes = random_nodes(seed, 80, p_levels=21, hot=True)
    nd = spark.createDataFrame(nodes, SCHEMA)
    for keys, at in ((["game"], (1,)), (["game", "oracle"], (1, 5))):
        got = {(r["tol"], r["gap"]): r["n"] for r in PR.pair_counts(nd, keys, bucket_cells=block).collect()}
        for tol in PR.PROGRESS_TOLS:
            for gap in PR.VALUE_GAPS:
                es = edges(nodes, round(tol * 1e9), round(gap * 1e9))
                assert got[tol, gap] == sum(all(a[k] == b[k] for k in at) for a, b, *_ in es)


def test_no_unit_holds_more_than_two_blocks(spark):
    nodes = [(f"n{i}", "hot", f"r{i % 5}", i * 1_000_000, i * 3_000_000, "c") for i in range(900)]
    cells = spark.createDataFrame(nodes, SCHEMA).groupBy("game", "p", "q").agg(F.count(F.lit(1)).alias("w"))
    sides = PR._halves(cells, ["game"], 250_000_000, 50)
    per = sides.groupBy("ba", "bb").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("side").alias("k")).collect()
    assert max(r["n"] for r in per) <= 100
    assert sum(r["ba"] == r["bb"] for r in per) == 18 and sum(r["ba"] != r["bb"] for r in per) < 18 * 17 / 2


def test_range_weights():
    rng = np.random.default_rng(0)
    r, w = rng.integers(0, 13, 90), rng.random(90)
    t = PR.RangeWeights(r, w, 13)
    lo = rng.integers(0, 90, 200)
    hi = np.minimum(90, lo + rng.integers(0, 50, 200))
    x = rng.integers(0, 14, 200)
    want = [w[a:b][r[a:b] < c].sum() for a, b, c in zip(lo, hi, x)]
    assert t.below(lo, hi, x) == pytest.approx(want)


@pytest.mark.parametrize("task_nodes", [0, 12, 1_000])
@pytest.mark.parametrize("seed, hot, levels", [(3, False, 6), (4, True, 2), (5, True, 1)])
def test_matching_equals_the_sequential_greedy(spark, seed, hot, levels, task_nodes):
    nodes = random_nodes(seed, 50, p_levels=levels, hot=hot)
    used, want = set(), set()
    for a, b, dp, dq in sorted(edges(nodes, 150_000_000, 500_000_000), key=lambda e: (e[2], -e[3], e[0][0], e[1][0])):
        if a[2] != b[2] and not {a[0], b[0]} & used:
            used |= {a[0], b[0]}
            want.add((a[0], b[0], dp, dq))
    got = PR.greedy_matching(spark.createDataFrame(nodes, SCHEMA), task_nodes=task_nodes).collect()
    assert {(r["a"], r["b"], r["dp"], r["dq"]) for r in got} == want and len(got) == len(want)


def test_a_chain_of_competing_edges_takes_one_step(spark, monkeypatch):
    """Progress gaps shrink along a line of nodes, so each edge waits for the next: rounds alone need half its length."""
    at, nodes = 0, []
    for i in range(60):
        nodes.append((f"n{i:03d}", "g", f"r{i}", at, (i % 2) * 600_000_000, "c"))
        at += 149_000_000 - i * 1_000_000
    calls = []
    monkeypatch.setattr(PR, "_mutual_best", lambda *a, real=PR._mutual_best: calls.append(1) or real(*a))
    got = {(r["a"], r["b"]) for r in PR.greedy_matching(spark.createDataFrame(nodes, SCHEMA)).collect()}
    assert got == {(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60, 2)} and not calls
    part = {(r["a"], r["b"]) for r in PR.greedy_matching(spark.createDataFrame(nodes, SCHEMA), task_nodes=56).collect()}
    assert part == got and len(calls) <= 3


def test_matching_of_no_nodes_and_of_nulls(spark):
    assert PR.greedy_matching(spark.createDataFrame([], SCHEMA)).count() == 0
    nodes = [("a", "g", "r1", 0, 0, "c"), ("b", "g", None, 0, 900_000_000, "c"), ("c", None, "r2", 0, 900_000_000, "c"), ("d", "g", "r3", None, 900_000_000, "c")]
    nodes += [("e", "g", "r4", 1, None, "c"), ("f", "g", "r5", 2, 900_000_000, "c")]
    got = PR.greedy_matching(spark.createDataFrame(nodes, SCHEMA)).collect()
    assert [(r["a"], r["b"], r["dp"], r["dq"]) for r in got] == [("a", "f", 2, 900_000_000)]


def test_threshold_choice(spark):
    g = spark.createDataFrame([(0.05, 0.5, 10), (0.10, 0.5, 60), (0.15, 0.5, 90), (0.05, 0.25, 500)], "tol double, gap double, n_cross_opposite long")
    r = PR.threshold_choice(g).first()
    assert r["tol"] == 0.10 and r["supported"]
    assert not PR.threshold_choice(g, need=1000).first()["supported"]


def test_ranking_accuracy_needs_enough_pairs(spark):
    pairs = spark.createDataFrame([("a", "b", True), ("c", "d", False)], "a string, b string, a_higher boolean")
    preds = spark.createDataFrame([(0, "m", i, s) for i, s in zip("abcd", (2.0, 1.0, 5.0, 3.0))], "seed int, model string, id string, score double")
    assert PR.ranking_accuracy(pairs, preds).first()["accuracy"] is None
    assert PR.ranking_accuracy(pairs, preds, 2).first()["accuracy"] == 0.5


def test_forecast_only_policy_never_quits_above_zero(spark):
    df = spark.createDataFrame([(-1.0, 0.3, -1.0, 0.2), (0.5, 0.1, 0.4, 0.2)], "p_qc_obs double, p_qi_obs double, qc double, qi double")
    cols = {"p_qi_stack": F.col("p_qi_obs"), "p_qc_act": F.col("p_qc_obs"), "p_qi_act": F.col("p_qi_obs"), "mapped": F.lit("quit")}
    d = PO.choices(df.withColumns(cols).withColumn("id", F.monotonically_increasing_id()), PO.ladder(F.lit(0.25)), ["id", "qc", "qi"])
    got = {}
    for r in PO.scored(d).collect():
        got.setdefault(r["policy"], []).append((r["choice"], r["regret"]))
    assert [c for c, _ in got["predict_only"]] == ["intervene", "continue"]
    assert [c for c, _ in got["no_intervene"]] == ["quit", "continue"]
    assert sum(r for _, r in got["ceiling"]) == 0.0


def test_unseen_level_continues(spark):
    rows = spark.createDataFrame([(0, 1, False, -1.0, 0.5), (0, 2, True, 0.1, 0.2), (0, 1, True, 0.1, 0.2)], "seed int, s_continue int, is_test boolean, qc double, qi double")
    got = {r["s_continue"]: r["mapped"] for r in PO.with_risk_choice(rows).collect()}
    assert got == {1: "intervene", 2: "continue"}


def test_transition_contributions_add_up(spark):
    rnd = random.Random(0)
    acts = ["continue", "intervene", "quit"]
    rows = [(rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.choice(acts), rnd.choice(acts), rnd.random(), rnd.random()) for _ in range(200)]
    t = PO.transitions(spark.createDataFrame(rows, "qc double, qi double, choice_o string, choice_a string, err_o double, err_a double")).cache()
    table = PO.transition_table(t).collect()
    assert sum(r["regret_contribution"] for r in table) == pytest.approx(t.agg(F.avg("dregret")).first()[0])
    assert sum(r["sse_share"] for r in table) == pytest.approx(1.0)
    assert {r["category"] for r in table} == {"unchanged", "fixed", "broken", "wrong_to_wrong"}


def test_level_contrasts_need_equal_splits(spark):
    rows = [(s, p, lv, r) for s in (0, 1) for p, r in (("poor", 1.0 + s), ("rich", 0.5)) for lv in (0, 1)]
    rows = [x for x in rows if x[:3] != (1, "rich", 1)] + [(0, "poor", 2, 1.0)]
    got = PO.level_contrasts(spark.createDataFrame(rows, "seed int, policy string, s_continue int, regret double"), {"k": ("poor", "rich")})
    by = {r["s_continue"]: r for r in got.collect()}
    assert (by[0]["n_poor"], by[0]["mean"], by[0]["consistent"]) == (2, 1.0, True) and by[0]["sd"] == pytest.approx(0.5**0.5)
    assert (by[1]["n_poor"], by[1]["n_rich"], by[1]["mean"]) == (2, 1, None)
    assert (by[2]["n_rich"], by[2]["mean"]) == (0, None)
