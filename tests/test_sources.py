import json

import pytest
from pyspark.sql import functions as F

from branchwise.functions.outcomes import ARM_B
from branchwise.operators import values as V
from branchwise.session import scratch_path
from branchwise.sources import corpus, shards
from branchwise.sources.schemas import BRANCH, BRANCH_CORE
from branchwise.streaming import ingest as G
from tests.test_values import full_group


def lines(groups, header=True):
    out = [json.dumps({"__provenance__": {"run_id": "r", "arm": ARM_B}})] if header else []
    keys = ("branch_id", "checkpoint_id", "arm", "action", "src", "replicate", "success", "n_steps_in_branch", "replay_verified")
    for g in groups:
        out += [json.dumps({k: v for k, v in zip(keys, r) if k != "src"}) for r in g]
    return out


@pytest.fixture()
def root(tmp_path):
    a, b = tmp_path / "branches.s007.jsonl", tmp_path / "branches.s003.rescue.jsonl"
    a.write_text("\n".join([*lines([full_group("cp_a", ""), full_group("cp_b", "")[:3]]), "", '{"checkpoint_id": "cp_x", "action": "cont']))
    b.write_text("\n".join(lines([full_group("cp_b", "")], header=False)) + "\n")
    return str(tmp_path)


def test_lenient_scan_and_census(spark, root):
    r = shards.read_records(spark, root, "branches", BRANCH_CORE)
    assert r.count() == 25
    per = {x["src"]: (x["records"], x["headers"], x["malformed"]) for x in shards.line_census(spark, root, "branches", BRANCH_CORE, "branch_id").collect()}
    assert per == {"branches.s007.jsonl": (14, 1, 1), "branches.s003.rescue.jsonl": (11, 0, 0)}
    assert [x["src"] for x in shards.read_provenance(spark, root, "branches", BRANCH_CORE).collect()] == ["branches.s007.jsonl"]
    assert shards.read_records(spark, root, "branches", BRANCH).count() == 25


def test_strict_scan_fails(spark, root):
    with pytest.raises(Exception):
        shards.read_strict(spark, root, "branches", BRANCH_CORE).collect()


def test_derivation_from_files(spark, root):
    v = V.derive(shards.read_records(spark, root, "branches", BRANCH_CORE), {ARM_B: 5})
    assert sorted(r["checkpoint_id"] for r in v.collect()) == ["cp_a", "cp_b"]


def test_bad_enum_fails_in_strict_form(spark, root):
    r = shards.read_records(spark, root, "branches", BRANCH_CORE)
    assert shards.violations(r).count() == 0 and shards.validated(r).count() == 25
    bad = r.withColumn("arm", F.lit("C"))
    assert shards.violations(bad).count() == 25
    with pytest.raises(Exception, match="bad arm"):
        shards.validated(bad).collect()


def test_shard_names():
    assert shards.shard_name("branches", 3, "rescue") == "branches.s003.rescue.jsonl"
    assert shards.shard_name("tasks") == "tasks.jsonl"


def test_append_refuses_an_existing_attempt(spark, tmp_path):
    planned = spark.createDataFrame([("a",), ("b",)], "checkpoint_id string")
    done = planned.where("checkpoint_id = 'a'")
    assert [r[0] for r in shards.append_missing(spark, planned, done, str(tmp_path), "x").collect()] == ["b"]
    with pytest.raises(Exception):
        shards.append_missing(spark, planned, done, str(tmp_path), "x")


def test_manifest_from_files(spark, tmp_path):
    for name, kind, solvable in (("g1", "a", True), ("g2", "b", False), ("g3-movable", "a", True), ("g4", "a", True), ("g5", "b", True)):
        d = tmp_path / name
        d.mkdir()
        (d / corpus.TRAJECTORY_FILE).write_text(json.dumps({"task_type": kind}))
        if name != "g5":
            (d / corpus.GAME_FILE).write_text(json.dumps({"solvable": solvable}))
    m = corpus.manifest(corpus.read_tree(spark, str(tmp_path)))
    assert sorted(r["folder"].rsplit("/", 1)[1] for r in m.collect()) == ["g1", "g4"]
    assert corpus.sample_per_type(m, 1).count() == 1


def test_stream_equals_batch_and_resumes(spark, root, tmp_path_factory):
    out, state = scratch_path(spark, "t-ingest"), scratch_path(spark, "t-state")
    assert G.ingest(G.shard_stream(spark, root, "branches", BRANCH_CORE, 1), out, state) > 20
    batch = G.running_counts(shards.read_records(spark, root, "branches", BRANCH_CORE))
    cols = sorted(batch.columns)
    assert sorted(map(tuple, G.current_counts(spark, out).select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    with open(f"{root}/branches.s009.late.jsonl", "w") as fh:
        late = lines([full_group("cp_c", "")], header=False)
        fh.write("\n".join([*late, late[0]]) + "\n")  # one record twice
    # Only the new file is read, and what it holds twice counts once.
    assert G.ingest(G.shard_stream(spark, root, "branches", BRANCH_CORE, 1), out, state) == len(late) + 1
    assert G.ingest(G.shard_stream(spark, root, "branches", BRANCH_CORE, 1), out, state) == 0
    batch = G.running_counts(shards.read_records(spark, root, "branches", BRANCH_CORE))
    assert sorted(map(tuple, G.current_counts(spark, out).select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    planned = spark.createDataFrame([(c,) for c in ("cp_a", "cp_b", "cp_c", "cp_d")], "checkpoint_id string")
    assert [r[0] for r in G.missing_units(planned, G.current_counts(spark, out), 5).collect()] == ["cp_d"]


def test_stream_looks_ids_up_in_its_records(spark, tmp_path):
    """An id met in an earlier batch of its shard counts once, in another shard again, and no state is kept for it."""
    out, state, root = (str(tmp_path / n) for n in ("out", "state", "root"))
    group = lines([full_group("cp_a", "")], header=False)
    for shard, name, text in (("s000", "a", group), ("s000", "b", [*group[:2], *lines([full_group("cp_b", "")], header=False)]), ("s001", "a", group)):
        folder = tmp_path / "root" / f"shard=branches.{shard}.jsonl"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"part-{name}.json").write_text("\n".join(text) + "\n")
        assert G.ingest(G.shard_stream(spark, root, "branches", BRANCH_CORE, 1), out, state) == len(text)
    batch = G.running_counts(shards.read_records(spark, root, "branches", BRANCH_CORE))
    cols = sorted(batch.columns)
    assert sorted(map(tuple, G.current_counts(spark, out).select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    assert spark.read.parquet(f"{out}/records").count() == 3 * len(group)
    assert not (tmp_path / "state" / "state").exists()
