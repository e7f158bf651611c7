import pytest
from pyspark.sql import functions as F

from branchwise.operators import splits as P
from branchwise.operators import traces as T

FIELDS = ["obs", "reward", "done", "commands", "facts"]
SCHEMA = "trace string, t long, action string, obs string, reward double, done boolean, commands array<string>, facts array<string>"


def world(n=5, obs_drift=None, fact_drift=None):
    rows = []
    for t in range(1, n + 1):
        obs = f"state {t}" + ("!" if t == obs_drift else "")
        facts = [f"at agent loc {t}" + ("?" if t == fact_drift else "")]
        rows.append(("w", t, f"a{t}", obs, 0.0, t == n, ["b", "a"], facts))
    return rows


def run(spark, rec, obs, **kw):
    return T.verify(spark.createDataFrame(rec, SCHEMA), spark.createDataFrame(obs, SCHEMA), ["trace"], "t", FIELDS, **kw).first()


def test_clean_trace(spark):
    v = run(spark, world(), [(*r[:6], ["a", "b"], r[7]) for r in world()])
    assert v["verified"] and v["match_rate"] == 1.0 and v["diff"] is None


@pytest.mark.parametrize("at", [1, 3, 5])
def test_first_divergence(spark, at):
    v = run(spark, world(), world(obs_drift=at))
    assert not v["verified"] and v["step_index"] == at - 1 and v["action"] == f"a{at}"
    assert v["match_rate"] == pytest.approx((at - 1) / at)
    assert v["diff"]["obs"]["actual"] == f"state {at}!" and v["diff"]["facts"] is None


def test_facts_only_drift_and_ignored_field(spark):
    v = run(spark, world(), world(fact_drift=2))
    assert v["step_index"] == 1 and v["diff"]["facts"]["only_actual"] == ["at agent loc 2?"]
    assert run(spark, world(), world(fact_drift=2), ignore=("facts",))["verified"]


def test_count_mismatch_is_an_error_not_a_mismatch(spark):
    v = run(spark, world(), world()[:-1])
    assert v["length_error"] and v["diff"] is None and not v["verified"]


def test_checkpoint_picks(spark):
    df = spark.createDataFrame([(f"r{n}", n) for n in range(0, 40)], "rollout_id string, n_steps int")
    got = {}
    for r in T.pick_checkpoints(df, 4).collect():
        got.setdefault(r["n_steps"], []).append(r["t"])
    for n in range(2, 40):
        ts = sorted(got[n])
        m = n - 1
        if m <= 4:
            assert ts == list(range(1, n))
        else:
            assert len(ts) == 4
            for i, t in enumerate(ts):
                assert 1 + i * m // 4 <= t < 1 + (i + 1) * m // 4
    assert 0 not in got and 1 not in got


def _cps(spark):
    return spark.createDataFrame([(f"t{a}", f"t{a}r{b}", c) for a in range(6) for b in range(2) for c in range(4)], "task_id string, rollout_id string, i int")


def test_count_split_respects_targets(spark):
    got = P.count_split(_cps(spark), "rollout_id", (8, 4, 8), 1).collect()
    per = {}
    for r in got:
        per[r["split"]] = per.get(r["split"], 0) + r["size"]
    assert per["train"] <= 8 and per["val"] <= 4 and per["test"] <= 8 and sum(per.values()) == 48


def test_no_leakage_and_planted_leak(spark):
    cps = _cps(spark).join(P.fraction_split(_cps(spark), "task_id", seed=2), "task_id")
    assert P.leakage(cps, "split", "rollout_id").count() == 0 and P.leakage(cps, "split", "task_id").count() == 0
    bad = cps.withColumn("split", F.when(F.col("i") == 0, "test").otherwise("train"))
    assert P.leakage(bad, "split", "rollout_id").count() == 12
    unused = cps.withColumn("split", F.when(F.col("i") == 0, "unused").otherwise("train"))
    assert P.leakage(unused, "split", "rollout_id").count() == 0


def test_fractions_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        P.fraction_split(_cps(spark), "task_id", (0.5, 0.2, 0.2))


def test_balanced_folds_match_the_greedy_rule(spark):
    import random

    rnd = random.Random(5)
    sizes = [(f"g{i}", rnd.choice([1, 1, 2, 3, 7, 20])) for i in range(57)]
    got = P.balanced_folds(spark.createDataFrame(sizes, "g string, size long"), [], "g", 5).collect()
    loads = [0] * 5
    for _, s in sorted(sizes, key=lambda x: -x[1]):
        loads[loads.index(min(loads))] += s
    mine = [0] * 5
    for r in got:
        mine[r["fold"]] += r["size"]
    assert sorted(mine) == sorted(loads) and len(got) == 57


def test_fill_matches_one_by_one():
    import random

    rnd = random.Random(1)
    for _ in range(300):
        loads = [rnd.randrange(0, 30) for _ in range(rnd.randrange(1, 6))]
        size, count = rnd.randrange(1, 9), rnd.randrange(0, 40)
        want, now = [0] * len(loads), list(loads)
        for _ in range(count):
            j = now.index(min(now))
            now[j] += size
            want[j] += 1
        assert P._fill(loads, size, count) == want


def test_grouped_holdout_has_a_test_group(spark):
    h = P.grouped_holdout(_cps(spark), "task_id", [0, 1, 2]).groupBy("seed").agg(F.count_if("is_test").alias("n")).collect()
    assert [r["n"] for r in h] == [2, 2, 2]
