import json

import pytest
from pyspark.sql import functions as F

from branchwise.operators import traces as T
from branchwise.session import scratch_path
from branchwise.sources import shards, vectors
from branchwise.sources.schemas import BRANCH, CHECKPOINT, ROLLOUT, TASK


def state(i, cmds):
    return {"obs": f"o{i}", "reward": 0.0, "done": False, "won": False, "admissible_commands": cmds, "facts": [f"at {i}"], "state_hash": f"h{i}"}


def test_nested_rollouts_become_steps(spark, tmp_path):
    rec = {
        "rollout_id": "r0",
        "task_id": "t0",
        "arm": "A_replication",
        "terminal_reason": "goal",
        "policy_seed": 4294967295,
        "initial": state(0, ["go", "look"]),
        "steps": [{"t": i, "action": f"a{i}", "confidence": None, **state(i + 1, ["go"])} for i in range(3)],
        "success": True,
        "n_steps": 3,
        "tokens": {"in": 5},
    }
    (tmp_path / "rollouts.s000.jsonl").write_text(json.dumps(rec) + "\n")
    r = shards.read_records(spark, str(tmp_path), "rollouts", ROLLOUT)
    assert r.first()["policy_seed"] == 4294967295
    s = T.steps_of(r).orderBy("t").collect()
    assert [x["t"] for x in s] == [0, 1, 2, 3] and s[0]["action"] is None and s[3]["action"] == "a2"
    cps = r.select("rollout_id", F.lit(2).cast("long").alias("t"))
    p = T.prefixes(cps, T.steps_of(r).where("t >= 1"), "rollout_id", ["action", "obs"], "steps").first()
    assert [x["action"] for x in p["steps"]] == ["a0", "a1"]


def test_rejected_units_are_kept_and_flagged(spark):
    b = spark.createDataFrame(
        [("c1", "goal", True, 4), ("c2", "goal", True, 5), ("c3", "step_cap", False, 6)],
        "cp string, terminal_reason string, success boolean, n_steps_in_branch int",
    )
    v = spark.createDataFrame([("c1", True), ("c2", False)], "cp string, verified boolean")
    got = {r["cp"]: tuple(r[1:]) for r in T.rejected_branches(b, v, "cp").select("cp", "replay_verified", "terminal_reason", "success", "n_steps_in_branch").collect()}
    assert got == {"c1": (True, "goal", True, 4), "c2": (False, "replay_mismatch", False, 0), "c3": (None, "step_cap", False, 6)}


def test_sinks(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", None)], "k string, v double")
    path = scratch_path(spark, "t-report")
    shards.write_report(df, path)
    assert spark.read.json(path).count() == 2
    with pytest.raises(Exception):
        shards.write_report(df, path)
    assert [r["line"] for r in shards.markdown_lines(df, ["k"]).collect()] == ["| a |  |", "| b | 2.0 |"]
    ids = scratch_path(spark, "t-ids")
    shards.write_id_list(df.select("k"), ids)
    assert [r[0] for r in spark.read.text(ids).collect()] == ["a", "b"]


def test_vector_store_prunes_layers(spark):
    df = spark.createDataFrame([(i, [float(j) for j in range(8)]) for i in range(3)], "id int, v array<double>")
    path = scratch_path(spark, "t-vectors")
    vectors.write_store(vectors.split_layers(df, "id", "v", 4, 2), path)
    got = vectors.load_layers(spark, path, [2])
    assert {tuple(r["vec"]) for r in got.collect()} == {(4.0, 5.0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "layer" in plan.split("ionFilters: ")[1].split("PushedFilters")[0]
    assert vectors.aligned(spark.createDataFrame([(1,)], "id int"), got, "id").count() == 1


def test_schemas_cover_every_entity():
    assert {f.name for f in TASK.fields} == {"task_id", "game_file", "task_type", "split_source", "solvable"}
    assert "features_26d" in CHECKPOINT.fieldNames() and "replay_mismatch" in BRANCH.fieldNames()
