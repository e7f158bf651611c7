import pytest
from pyspark.sql import functions as F

from branchwise.operators import quality as Q
from branchwise.operators import summaries as S
from branchwise.operators import values as V
from tests.test_traces_splits import FIELDS, SCHEMA, world
from tests.test_values import ARM, frame, full_group, row


def one(df):
    return df.first()["status"]


def test_planted_corruption_is_caught(spark):
    rec = [(f"w{i}", *r[1:]) for i in range(40) for r in world(3)]
    r = Q.planted_corruption(spark.createDataFrame(rec, SCHEMA), ["trace"], "t", FIELDS).first()
    assert r["status"] == "PASS" and r["n_checked"] > 0 and r["n_bad"] == 0


def test_unverified_row_fails_v1(spark):
    rows = full_group("a", "x")
    assert one(Q.verified_rows(frame(spark, rows))) == "PASS"
    assert one(Q.verified_rows(frame(spark, rows + [row("a", "continue", 9, True, 1, ok=False)]))) == "FAIL"


def test_arm_checks(spark):
    same = [row("a", "continue", i, True, 3, arm="A_replication") for i in range(2)]
    assert one(Q.deterministic_arm(frame(spark, same))) == "PASS"
    assert one(Q.deterministic_arm(frame(spark, same + [row("a", "continue", 2, True, 4, arm="A_replication")]))) == "FAIL"
    assert one(Q.stochastic_arm(frame(spark, full_group("a", "x")))) == "PASS"
    assert one(Q.stochastic_arm(frame(spark, same))) == "SKIP"


def test_stored_columns(spark):
    a = spark.createDataFrame([(1, [1, 2]), (2, None), (3, [4])], "k int, v array<int>")
    b = spark.createDataFrame([(1, [1, 2]), (2, [9]), (3, [5])], "k int, v array<int>")
    r = Q.stored_arrays(a, b, ["k"], "v").first()
    assert (r["status"], r["n_checked"], r["n_bad"]) == ("FAIL", 2, 1)
    assert one(Q.stored_arrays(a.where("v is null"), b, ["k"], "v")) == "SKIP"


def test_order_free_and_totals(spark):
    df = frame(spark, full_group("a", "x") + full_group("b", "y"))
    suite = Q.suite([Q.order_free(df, {ARM: 5}), Q.verified_rows(df)])
    t = Q.suite_totals(suite).first()
    assert (t["pass"], t["fail"], t["skip"], t["exit_status"]) == (2, 0, 0, 0)


def test_guard_fails_the_job(spark):
    rows = spark.createDataFrame([("g1",), ("g1",), ("g2",)], "g string")
    assert tuple(Q.evaluation_guard(rows, "g", 3, 2).first()) == (3, 2)
    with pytest.raises(Exception, match="evaluation set changed"):
        Q.evaluation_guard(rows, "g", 4, 2).collect()


def test_disagreeing_paths_are_void(spark):
    a = spark.createDataFrame([("k", 0.5), ("m", 0.1)], "k string, s double")
    assert one(Q.two_paths_agree(a, a.withColumn("s", F.col("s") + 1e-4), ["k"], "s")) == "PASS"
    assert one(Q.two_paths_agree(a, a.withColumn("s", F.col("s") + 1e-3), ["k"], "s")) == "FAIL"
    assert one(Q.two_paths_agree(a, a.where("k = 'k'"), ["k"], "s")) == "FAIL"


def test_audit_classes(spark):
    rows = full_group("a", "x") + full_group("b", "x")[:4] + full_group("z", "x")
    c = V.census(V.select_attempts(V.attempt_stats(frame(spark, rows))), {ARM: 5})
    planned = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "checkpoint_id string, task_id int")
    classes = Q.planned_classes(planned, c)
    assert {r["checkpoint_id"]: r["class"] for r in classes.collect()} == {"a": "complete", "b": "partial", "c": "absent", "z": "orphan"}
    assert sorted(r[0] for r in Q.rerun_list(classes).collect()) == ["b", "c"]
    assert [r["task_id"] for r in Q.lost_games(planned, c.where("complete")).collect()] == [2]


def test_variance_inside_groups(spark):
    import numpy as np

    rows = [("a", f"k{i % 3}", i % 25, float((i * 13) % 7)) for i in range(90)]
    got = {r["grouping"]: r["within_var"] for r in S.within_group_variance(spark.createDataFrame(rows, "arm string, task_type string, t int, tau double")).collect()}
    for name, key in (("task_type", lambda r: r[1]), ("step", lambda r: r[2]), ("type_x_bucket", lambda r: (r[1], r[2] // 10))):
        groups = {}
        for r in rows:
            groups.setdefault(key(r), []).append(r[3])
        assert got[name] == pytest.approx(sum(len(g) * np.var(g) for g in groups.values()) / 90)
