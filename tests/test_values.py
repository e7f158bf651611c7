import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchwise.functions.outcomes import Utility, realized_utility, sweep_grid
from branchwise.operators import bins as B
from branchwise.operators import values as V

ARM = "B_montecarlo"
SCHEMA = (
    "branch_id string, checkpoint_id string, arm string, action string, src string, replicate int, "
    "success boolean, n_steps_in_branch int, replay_verified boolean"
)


def row(cp, action, rep, success, steps, src="branches.s000.jsonl", ok=True, arm=ARM):
    return (f"{cp}::{action}::{rep}", cp, arm, action, src, rep, success, steps, ok)


def full_group(cp, src, n=5):
    rows = [row(cp, a, i, i % 2 == 1, 3, src) for a in ("continue", "intervene") for i in range(n)]
    return rows + [row(cp, "quit", 0, False, 0, src)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_realized_utility(spark):
    df = spark.createDataFrame(
        [("continue", True, 10), ("continue", False, 10), ("intervene", True, 10), ("quit", False, 99)],
        "action string, success boolean, steps int",
    )
    u = realized_utility(F.col("action"), F.col("success"), F.col("steps"), Utility().columns())
    got = [r[0] for r in df.select(u).collect()]
    assert got == pytest.approx([0.90, -1.10, 0.85, 0.0])


def test_bad_action_fails(spark):
    df = spark.createDataFrame([("jump", True, 1)], "action string, success boolean, steps int")
    u = realized_utility(F.col("action"), F.col("success"), F.col("steps"), Utility().columns())
    with pytest.raises(Exception, match="unknown action"):
        df.select(u).collect()


def test_pair_of_values(spark):
    rows = [row("a", "continue", 0, False, 10), row("a", "intervene", 0, True, 8), row("a", "quit", 0, False, 0)]
    v = V.strict_values(frame(spark, rows)).first()
    assert v["value_continue"] == pytest.approx(-1.10)
    assert v["value_intervene"] == pytest.approx(0.87)
    assert v["tau"] == pytest.approx(1.97)
    assert v["oracle_action"] == "intervene" and v["p_fail_continue"] == 1.0
    assert v["se_continue"] == 0.0


def test_quit_wins_when_both_lose(spark):
    rows = [row("a", "continue", 0, False, 1), row("a", "intervene", 0, False, 1)]
    v = V.strict_values(frame(spark, rows)).first()
    assert v["oracle_action"] == "quit" and v["oracle_value"] == 0.0


def test_ties_go_to_the_earlier_action(spark):
    p = Utility(intervention_cost=0.0)
    rows = [row("a", "continue", 0, True, 5), row("a", "intervene", 0, True, 5)]
    assert V.strict_values(frame(spark, rows), p).first()["oracle_action"] == "continue"


def test_standard_error_matches_direct_formula(spark):
    data = [(True, 3), (False, 7), (True, 12), (False, 2), (True, 9)]
    rows = [row("a", "continue", i, s, m) for i, (s, m) in enumerate(data)]
    rows += [row("a", "intervene", 0, True, 1)]
    v = V.strict_values(frame(spark, rows)).first()
    us = [(1.0 if s else -1.0) - 0.01 * m for s, m in data]
    mean = sum(us) / 5
    se = math.sqrt(sum((u - mean) ** 2 for u in us) / 4 / 5)
    assert v["value_continue"] == pytest.approx(mean) and v["se_continue"] == pytest.approx(se)


@pytest.mark.parametrize(
    "rows, message",
    [
        ([row("a", "continue", 0, True, 1, ok=False), row("a", "intervene", 0, True, 1)], "unverified"),
        ([row("a", "continue", 0, True, 1)], "missing action"),
        ([row("a", "jump", 0, True, 1), row("a", "continue", 0, True, 1), row("a", "intervene", 0, True, 1)], "unknown action"),
    ],
)
def test_violations_fail(spark, rows, message):
    with pytest.raises(Exception, match=message):
        V.strict_values(frame(spark, rows)).collect()


def test_grid_has_25_settings():
    grid = sweep_grid()
    assert len({u.name for u in grid}) == 25
    assert len({(u.intervention_cost, u.wrong_penalty) for u in grid}) == 25


def test_sweep_equals_direct_derivation(spark):
    rows = []
    for i in range(30):
        for a in ("continue", "intervene"):
            rows += [row(f"c{i}", a, r, (i * 7 + r * 3 + len(a)) % 3 == 0, (i * 5 + r) % 11) for r in range(3)]
        rows.append(row(f"c{i}", "quit", 0, False, 0))
    g = V.complete_groups(frame(spark, rows), {ARM: 3}).cache()
    swept = B.abstraction_loss(B.band_stats(V.swept_cells(g), ["arm", "params"], F.col("weight")), ["arm", "params"])
    got = {r["params"]: r for r in swept.collect()}
    for u in (sweep_grid()[0], sweep_grid()[13], sweep_grid()[24]):
        want = B.abstraction_loss(B.band_stats(V.checkpoint_values(g, u), ["arm"]), ["arm"]).first()
        assert got[u.name]["gap"] == pytest.approx(want["gap"])
        assert got[u.name]["conflict_mass"] == pytest.approx(want["conflict_mass"])
        assert got[u.name]["n"] == 30


def _census(spark, rows, n=5):
    c = V.census(V.select_attempts(V.attempt_stats(frame(spark, rows))), {ARM: n})
    return {r["checkpoint_id"]: (r["complete"], r["reason"]) for r in c.collect()}


def test_census_reasons(spark):
    s = "branches.s000.jsonl"
    rows = full_group("full", s)
    rows += [r for r in full_group("short", s) if r[0] not in ("short::continue::3", "short::continue::4")]
    rows += [r if r[0] != "bad::intervene::2" else (*r[:-1], False) for r in full_group("bad", s)]
    rows += full_group("over", s, 6)
    rows += [r for r in full_group("noquit", s) if r[3] != "quit"]
    assert _census(spark, rows) == {
        "full": (True, "ok"),
        "short": (False, "short:continue-2"),
        "bad": (False, "unverified_replay"),
        "over": (False, "DUPLICATE_RECORDS:continue+1,intervene+1"),
        "noquit": (False, "short:quit-1"),
    }


def test_partial_attempt_is_superseded(spark):
    first, rescue = "branches.s007.jsonl", "branches.s003.rescue.jsonl"
    rows = full_group("cp_a", first) + full_group("cp_b", first)[:3] + full_group("cp_b", rescue)
    df = frame(spark, rows)
    rep = V.attempt_report(V.attempt_stats(df)).first()
    assert (rep["checkpoints_with_multiple_sources"], rep["records_superseded"]) == (1, 3)
    assert _census(spark, rows) == {"cp_a": (True, "ok"), "cp_b": (True, "ok")}
    kept = V.selected_branches(df)
    assert kept.count() == 22
    assert {r["src"] for r in kept.where("checkpoint_id = 'cp_b'").collect()} == {rescue}
    cohorts = {r[0]: r[1] for r in V.attempt_winners(df).select("checkpoint_id", V.cohort_of(F.col("src"))).collect()}
    assert cohorts == {"cp_a": "original", "cp_b": "rescue"}


def test_two_complete_attempts_keep_the_first_file(spark):
    rows = full_group("cp", "branches.s001.jsonl") + full_group("cp", "branches.s000.r2.jsonl")
    kept = V.selected_branches(frame(spark, rows))
    assert kept.count() == 11 and {r["src"] for r in kept.collect()} == {"branches.s000.r2.jsonl"}


def test_duplicate_ids_inside_an_attempt_count_once(spark):
    rows = full_group("cp", "branches.s000.jsonl")
    rows.append(rows[0])
    assert _census(spark, rows) == {"cp": (True, "ok")}
    rep = V.attempt_report(V.attempt_stats(frame(spark, rows))).first()
    assert rep["duplicate_branch_ids_dropped"] == 1


def test_usable_includes_quit(spark):
    rows = full_group("a", "x") + [r if r[3] != "quit" else (*r[:-1], False) for r in full_group("b", "x")]
    assert [r[0] for r in V.usable_checkpoints(frame(spark, rows)).collect()] == ["a"]


def test_many_levels_use_quantile_edges(spark):
    import numpy as np

    vals = [float((i * 37) % 101) for i in range(60)]
    lv = spark.createDataFrame([("a", v, 1 + i % 3) for i, v in enumerate(vals)], "k string, risk double, n long")
    got = {r["risk"]: r["bin"] for r in B.binned(lv, ["k"]).collect()}
    data = np.repeat(vals, [1 + i % 3 for i in range(60)])
    edges = np.quantile(data, np.linspace(0, 1, 11)[1:-1])
    assert got == {v: int(np.searchsorted(edges, v)) for v in vals}


def test_spread_keeps_its_digits_far_from_zero(spark):
    rng = np.random.default_rng(0)
    rows = [("B", 40, int(k), 0.0, 1e6 + float(x), 1e6, 1e6 + float(x), "intervene") for k, x in zip(rng.integers(0, 30, 400), rng.normal(0, 1e-3, 400))]
    df = spark.createDataFrame(rows, "arm string, n_continue long, s_continue long, value_continue double, value_intervene double, oracle_value double, tau double, oracle_action string")
    bands = B.band_stats(df, ["arm"])
    levels = {r["risk"]: r["bin"] for r in B.binned(B.risk_levels(df, ["arm"]), ["arm"]).collect()}
    by = {}
    for r in rows:
        by.setdefault(levels[1.0 - r[2] / r[1]], []).append(r[6])
    got = {r["bin"]: r["tau_sd"] for r in B.tau_spread(bands).collect()}
    assert len(got) == 10 and got == {b: pytest.approx(np.std(x, ddof=1), rel=1e-5) for b, x in by.items()}


def test_attempt_statistics_move_rows_once(spark):
    """Repeated ids, sums and the chosen attempt follow in the task that a checkpoint was dealt to; odd ids stay apart."""
    rows = full_group("a", "branches.s000.jsonl") + full_group("a", "branches.s001.r1.jsonl", 4)
    odd = [(i, "a", ARM, "continue", "branches.s000.jsonl", 9, True, 1, True) for i in ("=::x", "a=::x", "::x", "!a", "a", "a")]
    chosen = V.select_attempts(V.attempt_stats(frame(spark, rows + odd)))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    r = chosen.first()
    assert (r["src"], r["n_records"], r["n_kept"], r["n_continue"]) == ("branches.s000.jsonl", 17, 16, 10)


def test_shards_are_written_compressed(spark, tmp_path):
    from branchwise.sources import shards
    from branchwise.sources.schemas import BRANCH_CORE

    root = str(tmp_path / "shards")
    shards.write_shards(shards.to_lines(frame(spark, full_group("a", "branches.s000.jsonl"))), root)
    files = [f.name for f in (tmp_path / "shards").rglob("part-*")]
    assert files and all(f.endswith(".gz") for f in files)
    assert shards.read_records(spark, root, "branches", BRANCH_CORE).count() == 11


def test_selected_branches_read_their_records_once(spark, tmp_path):
    rows = full_group("a", "branches.s000.jsonl") + full_group("a", "branches.s001.r1.jsonl", 4)
    frame(spark, rows).write.parquet(str(tmp_path / "rows"))
    kept = V.selected_branches(spark.read.parquet(str(tmp_path / "rows")))
    assert kept._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r["src"] for r in kept.collect()} == {"branches.s000.jsonl"} and kept.count() == 11


def test_order_lines_are_dealt_once_for_values(spark, monkeypatch):
    """Numbering, attempts and values follow in the task that a part was dealt to; a hot part gives the same values."""
    from branchwise.plans import common, views

    sf = "/root/testdata/sf0.001"
    cols = ["checkpoint_id", "arm", "src", "tau", "n_records", "task_id", "progress"]
    plain = common.plain_values(spark, sf)
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    whole = sorted(map(str, common.full_values(spark, sf).select(cols).collect()))
    monkeypatch.setattr(views, "full_buckets", lambda *a: [1])
    assert whole and whole == sorted(map(str, common.full_values(spark, sf).select(cols).collect()))


def test_policies_and_pairs_derive_values_once(spark, monkeypatch):
    from branchwise.plans import policy_queries as Q

    calls, real = [], Q.full_values
    monkeypatch.setattr(Q, "full_values", lambda *a: calls.append(1) or real(*a))
    Q.pair_ranking(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
