"""Sources, attempt selection, audit, set operations, splits, quality suite."""

from __future__ import annotations

from pyspark.sql import functions as F

from branchwise.functions import ids as I
from branchwise.functions.outcomes import ARM_A, ARM_B
from branchwise.operators import quality as Q
from branchwise.operators import splits as P
from branchwise.operators import values as V
from branchwise.plans import views
from branchwise.plans.common import full_values, tidy, tidy_sql
from branchwise.plans.text_queries import STEP_FIELDS
from branchwise.plans.views import table, with_views
from branchwise.session import scratch_path, stored
from branchwise.sources import corpus, shards, vectors
from branchwise.sources.schemas import BRANCH_CORE

SEEDS = [0, 1, 2, 3, 4]


# ----------------------------------------------------------------- sources


def shard_lines(spark, sf, src=None):
    """(src, line) of two shards, or of one: data lines, a header per shard and one cut line."""
    b = views.branches(spark, sf)
    named = spark.createDataFrame([("branches.s000.jsonl",), ("branches.s001.r1.jsonl",)], "src string")
    header = named.select("src", shards.header_line("run0", ARM_B, "cafe", n_replicates=3).alias("line"))
    cut = named.where("src = 'branches.s001.r1.jsonl'").select("src", F.lit('{"checkpoint_id": "cp_x", "action": "cont').alias("line"))
    lines = shards.to_lines(b).unionByName(header).unionByName(cut)
    return lines if src is None else lines.where(F.col("src") == src)


def _root(spark, sf) -> str:
    """Shards written for this call."""
    root = scratch_path(spark, "shards")
    shards.write_shards(shard_lines(spark, sf), root)
    return root


def _records(spark, sf):
    return shards.read_records(spark, _root(spark, sf), "branches", BRANCH_CORE)


def shard_scan(spark, sf):
    r = _records(spark, sf)
    return tidy(
        r.groupBy("src", "arm", "action").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("n_steps_in_branch").alias("steps"),
            F.count_if("success").alias("wins"),
            F.count_if("replay_verified").alias("verified"),
        )
    )


def strict_shard_scan(spark, sf):
    """Strict reading of the one shard set without damage: a copy holding good lines only."""
    good = _records(spark, sf)
    root = scratch_path(spark, "strict")
    shards.write_shards(shards.to_lines(good), root)
    r = shards.read_strict(spark, root, "branches", BRANCH_CORE)
    return tidy(r.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("branch_id").alias("ids")))


def line_census(spark, sf):
    return tidy(shards.line_census(spark, _root(spark, sf), "branches", BRANCH_CORE, "branch_id"))


def provenance(spark, sf):
    p = shards.read_provenance(spark, _root(spark, sf), "branches", BRANCH_CORE)
    return tidy(p.select("src", "run_id", "arm", "config_hash", "n_replicates"))


def record_violations(spark, sf):
    """Order lines read as branches without mapping their flags: every row breaks an enum."""
    li = table(spark, sf, "lineitem")
    raw = li.select(
        F.col("l_orderkey").cast("string").alias("branch_id"),
        F.col("l_partkey").cast("string").alias("checkpoint_id"),
        F.lit(ARM_B).alias("arm"),
        F.when(F.col("l_returnflag") == "A", "continue").otherwise(F.col("l_returnflag")).alias("action"),
        F.when(F.col("l_linestatus") == "O", "goal").otherwise(F.col("l_linestatus")).alias("terminal_reason"),
    )
    return tidy(shards.violations(raw).groupBy("rule").agg(F.count(F.lit(1)).alias("n")))


def attempt_selection(spark, sf):
    """Winning rows read from the shards."""
    r = _records(spark, sf).drop("terminal_reason", "branch_seed")
    s = V.selected_branches(shards.validated(r).withColumn("key", F.concat_ws("/", "arm", "branch_id")).drop("branch_id").withColumnRenamed("key", "branch_id"))
    return tidy(s.select("arm", "branch_id", "src", "success", "n_steps_in_branch", "replay_verified"))


def attempt_report(spark, sf):
    return tidy(V.attempt_report(V.attempt_stats(_records(spark, sf))))


def records_per_source(spark, sf):
    return tidy(V.records_per_source(V.attempt_stats(_records(spark, sf))))


def cohort_labels(spark, sf):
    w = V.attempt_winners(_records(spark, sf))
    return tidy(w.withColumn("cohort", V.cohort_of(F.col("src"))).groupBy("arm", "cohort").agg(F.count(F.lit(1)).alias("n")))


def incomplete_reissue(spark, sf):
    """Resume: units not complete in the first shard, appended as a new attempt."""
    planned = views.checkpoints(spark, sf).select("checkpoint_id")
    first = views.branches(spark, sf).where((F.col("arm") == ARM_B) & (F.col("src") == "branches.s000.jsonl"))
    done = V.complete_groups(first, views.N_REPLICATES)
    return shards.append_missing(spark, planned, done, scratch_path(spark, "resume"), "r2")


def vector_layers(spark, sf):
    e = table(spark, sf, "embeddings")
    long = vectors.split_layers(e, "vec_id", "embedding", 4, 16)
    path = scratch_path(spark, "vectors")
    vectors.write_store(long, path)
    v = vectors.load_layers(spark, path, [1, 3])
    return tidy(
        v.groupBy("layer").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.size("vec")).alias("values"),
            F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total"),
        ),
        4,
    )


def _files(spark, sf):
    """Two documents per page folder; task type from the page number, solvable from its markup."""
    p = table(spark, sf, "pages")
    variant = F.when(F.col("page_id") % 9 == 0, "-movable").when(F.col("page_id") % 11 == 0, "-Sliced").otherwise("")
    folder = F.concat(F.lit("/games/"), F.col("page_id"), variant)
    kind = F.to_json(F.struct(views.task_type_of(F.col("page_id")).alias("task_type"), F.col("url").alias("scene")))
    game = F.to_json(F.struct(F.contains(F.col("html"), F.lit("<article>")).alias("solvable"), F.length("html").alias("size")))
    docs = F.array(
        F.struct(F.concat(folder, F.lit("/" + corpus.TRAJECTORY_FILE)).alias("path"), kind.alias("content")),
        F.struct(F.concat(folder, F.lit("/" + corpus.GAME_FILE)).alias("path"), game.alias("content")),
    )
    return p.select(F.explode(docs).alias("d")).select("d.*")


def _tree(spark, sf):
    """The files written as a tree and walked again, with paths below its root."""
    root = scratch_path(spark, "tree")
    corpus.write_tree(_files(spark, sf), root)
    below = F.substring_index("path", root.rpartition("/")[2], -1)
    return corpus.read_tree(spark, root).withColumn("path", below)


def corpus_manifest(spark, sf):
    return corpus.manifest(_tree(spark, sf))


def corpus_sample(spark, sf):
    return corpus.sample_per_type(corpus.manifest(_tree(spark, sf)), 3)


# ------------------------------------------------------------------- audit


def _audit(spark, sf):
    """Plan: all orders not pending. Observed: order-level branches of arm A."""
    planned = views.planned_orders(spark, sf)
    b = views.branches(spark, sf, "order").where(F.col("arm") == ARM_A)
    return planned, V.census(V.select_attempts(V.attempt_stats(b)), views.N_REPLICATES)


def audit_classes(spark, sf):
    return Q.planned_classes(*_audit(spark, sf))


def audit_class_counts(spark, sf):
    return tidy(Q.class_counts(Q.planned_classes(*_audit(spark, sf))))


def audit_partial_reasons(spark, sf):
    return tidy(Q.partial_reasons(Q.planned_classes(*_audit(spark, sf))))


def rerun_list(spark, sf):
    path = scratch_path(spark, "rerun")
    shards.write_id_list(Q.rerun_list(Q.planned_classes(*_audit(spark, sf))), path)
    return spark.read.text(path).select(F.col("value").alias("checkpoint_id"))


def remaining_units(spark, sf):
    planned, census = _audit(spark, sf)
    return Q.remaining_units(planned, census).select("checkpoint_id")


def lost_games(spark, sf):
    planned, census = _audit(spark, sf)
    return tidy(Q.lost_games(planned, census.where("complete")))


def set_differences(spark, sf):
    """Planned minus seen, seen minus planned, and both, as counts."""
    planned, census = _audit(spark, sf)
    p, s = planned.select("checkpoint_id"), census.select("checkpoint_id")
    parts = [("planned_only", p.subtract(s)), ("seen_only", s.subtract(p)), ("shared", p.intersect(s)), ("any", p.union(s).distinct())]
    out = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def shared_games(spark, sf):
    """Games seen in one cohort, the other, or both, with their usable checkpoints."""
    v = full_values(spark, sf).where(F.col("arm") == ARM_B)
    per = v.groupBy("task_id").agg(
        F.count_if(F.col("cohort") == "original").alias("a"), F.count_if(F.col("cohort") != "original").alias("b")
    )
    label = F.when((F.col("a") > 0) & (F.col("b") > 0), "both").when(F.col("a") > 0, "original_only").otherwise("r1_only")
    return tidy(
        per.groupBy(label.alias("seen")).agg(
            F.count(F.lit(1)).alias("games"), F.sum("a").alias("rows_original"), F.sum("b").alias("rows_r1")
        )
    )


def unseen_games(spark, sf):
    """Rows of the second cohort whose game the first never saw (anti) or saw (semi)."""
    v = stored(
        full_values(spark, sf).where(F.col("arm") == ARM_B).select("checkpoint_id", "task_id", "cohort", "tau"), "cohorts"
    )
    seen = v.where("cohort = 'original'").select("task_id").distinct()
    dest = v.where("cohort <> 'original'")
    a = dest.join(seen, "task_id", "left_anti").withColumn("seen", F.lit(False))
    b = dest.join(seen, "task_id", "left_semi").withColumn("seen", F.lit(True))
    return tidy(a.unionByName(b).groupBy("seen").agg(F.count(F.lit(1)).alias("n"), F.avg("tau").alias("tau_mean")))


# ------------------------------------------------------------------ splits


def count_split(spark, sf):
    return tidy(P.count_split(views.checkpoints(spark, sf), "rollout_id", (40, 20, 40), 3))


def fraction_split(spark, sf):
    return tidy(P.fraction_split(views.checkpoints(spark, sf), "task_id", (0.6, 0.2, 0.2), 11))


def grouped_holdout(spark, sf):
    return tidy(P.grouped_holdout(views.checkpoints(spark, sf), "task_id", SEEDS))


def balanced_fold_loads(spark, sf):
    """Rows and groups per fold over customers' orders."""
    sizes = P.group_sizes(table(spark, sf, "orders"), "o_custkey")
    f = P.balanced_folds(sizes, [], "o_custkey", 5, 0)
    return tidy(f.groupBy("fold").agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("n_groups")))


def split_leakage(spark, sf):
    """Rollouts of a row-wise split that straddle train and test."""
    cps = views.checkpoints(spark, sf)
    rows = P.row_holdout(cps, "checkpoint_id", [0]).withColumn("split", F.when(F.col("is_test"), "test").otherwise("train"))
    return tidy(P.leakage(rows, "split", "rollout_id"))


def split_sizes(spark, sf):
    cps = views.checkpoints(spark, sf)
    h = P.grouped_holdout(cps, "task_id", SEEDS)
    return tidy(P.split_sizes(cps.select("task_id").join(h, "task_id"), (100, 40)))


def group_overlap(spark, sf):
    return tidy(P.group_overlap(P.row_holdout(views.checkpoints(spark, sf), "checkpoint_id", SEEDS), "task_id"))


# ----------------------------------------------------------------- quality


def _chosen(*keys):
    """About one key in sixteen, by a hash."""
    return F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 1) == "0"


def quality_suite(spark, sf):
    b = stored(views.branches(spark, sf), "branches")
    cps = views.checkpoints(spark, sf)
    ranked = P.fraction_split(cps, "task_id", seed=11).withColumnRenamed("split", "split_task")
    ps = P.count_split(cps, "rollout_id", (40, 20, 40), 3).select("rollout_id", F.col("split").alias("split_paper"))
    labelled = cps.join(ranked, "task_id").join(ps, "rollout_id")
    again = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("ids"))
    # Damage planted in the stored copies, which the checks must find exactly.
    turn_hit = _chosen("conv_id", "turn")
    c = stored(again.withColumn("ids", F.when(turn_hit, F.array_append("ids", F.lit("?"))).otherwise(F.col("ids"))), "ids")
    s = stored(views.steps(spark, sf), "steps")

    def hashed(d):
        sig = I.state_signature(F.col("obs"), F.col("commands"), F.col("reward"), F.col("done"), F.lit(False), F.array("action"))
        return d.select("trace", "t", I.signature_hash(sig).alias("h"))

    state_hit = _chosen("trace", "t")
    kept = stored(hashed(s).withColumn("h", F.when(state_hit, F.reverse("h")).otherwise(F.col("h"))), "hashes")
    checks = [
        Q.verified_rows(b),
        Q.planted_corruption(s, ["trace"], "t", STEP_FIELDS),
        Q.stored_hashes(kept, hashed(views.steps(spark, sf)), ["trace", "t"], "h", state_hit),
        Q.deterministic_arm(b),
        Q.stochastic_arm(b),
        Q.takeover_success(b, cps, views.tasks(spark, sf)),
        Q.base_success(views.rollouts(spark, sf)),
        Q.no_leakage(labelled, [("split_paper", "rollout_id"), ("split_task", "task_id"), ("split_task", "rollout_id")]),
        Q.order_free(b, views.N_REPLICATES),
        Q.stored_arrays(c, again, ["conv_id", "turn"], "ids", turn_hit),
    ]
    return tidy(Q.suite(checks))


def quality_suite_totals(spark, sf):
    return tidy(Q.suite_totals(quality_suite(spark, sf)))


def standard_error_spread(spark, sf):
    return tidy(Q.standard_error_spread(views.branches(spark, sf)))


def worst_task_type(spark, sf):
    return tidy(Q.worst_task_type(views.branches(spark, sf), views.checkpoints(spark, sf), views.tasks(spark, sf)))


def evaluation_guard(spark, sf):
    """Guard of the checkpoint view against counts taken from the order lines and parts alone."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("key"))
    have = part.join(views.blocks(spark, sf), "key", "left")
    n, g = have.agg(F.sum(F.coalesce("n_blocks", F.lit(1))), F.countDistinct(F.floor(F.col("key") / 8))).first()
    return tidy(Q.evaluation_guard(views.checkpoints(spark, sf), "task_id", n, g))


def paths_agree(spark, sf):
    """Mean advantage per task type from rows and from per-checkpoint differences."""
    v = stored(full_values(spark, sf).where(F.col("arm") == ARM_B).select("task_type", "tau", "value_continue", "value_intervene"), "paths")
    a = v.groupBy("task_type").agg(F.avg("tau").alias("score"))
    b = v.groupBy("task_type").agg((F.avg("value_intervene") - F.avg("value_continue")).alias("score"))
    return tidy(Q.two_paths_agree(a, b, ["task_type"], "score"))


QUERIES = {
    f.__name__: f
    for f in (
        shard_scan,
        strict_shard_scan,
        line_census,
        provenance,
        record_violations,
        attempt_selection,
        attempt_report,
        records_per_source,
        cohort_labels,
        incomplete_reissue,
        vector_layers,
        corpus_manifest,
        corpus_sample,
        audit_classes,
        audit_class_counts,
        audit_partial_reasons,
        rerun_list,
        remaining_units,
        lost_games,
        set_differences,
        shared_games,
        unseen_games,
        count_split,
        fraction_split,
        grouped_holdout,
        balanced_fold_loads,
        split_leakage,
        split_sizes,
        group_overlap,
        quality_suite,
        quality_suite_totals,
        standard_error_spread,
        worst_task_type,
        evaluation_guard,
        paths_agree,
    )
}

# ------------------------------------------------------------------ oracle

_AUDIT = """
planned AS (SELECT * FROM planned_orders),
seen AS (SELECT checkpoint_id, reason, reason = 'ok' AS complete FROM order_census WHERE arm = 'A_replication'),
classes AS (
  SELECT coalesce(p.checkpoint_id, s.checkpoint_id) AS checkpoint_id,
    CASE WHEN p.checkpoint_id IS NULL THEN 'orphan' WHEN s.checkpoint_id IS NULL THEN 'absent' WHEN s.complete THEN 'complete' ELSE 'partial' END AS class, reason
  FROM planned p FULL JOIN seen s ON p.checkpoint_id = s.checkpoint_id)"""

_MANIFEST = f"""
folders AS (
  SELECT '/games/' || page_id || CASE WHEN page_id % 9 = 0 THEN '-movable' WHEN page_id % 11 = 0 THEN '-Sliced' ELSE '' END AS folder,
    ({views._TASKS})[1 + page_id % 6] AS task_type, contains(html, '<article>') AS solvable FROM pages),
games AS (SELECT folder, task_type FROM folders WHERE solvable AND NOT contains(folder, 'movable') AND NOT contains(folder, 'Sliced'))"""

_HOLD = """
hold AS (
  SELECT seed, task_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || task_id)) <= greatest(1, round_even(3e-1 * count(*) OVER (PARTITION BY seed), 0)) AS is_test
  FROM (SELECT DISTINCT task_id FROM checkpoints), range(0, 5) s(seed))"""

_ROWSPLIT = """
rowsplit AS (
  SELECT c.*, seed, ('0x' || substr(md5(seed || '|' || checkpoint_id), 1, 8))::BIGINT / 4294967296e0 < 3e-1 AS is_test
  FROM checkpoints c, range(0, 5) s(seed))"""

_COUNT_SPLIT = """
gs AS (SELECT rollout_id, count(*) AS size, md5('3|' || rollout_id) AS h FROM checkpoints GROUP BY rollout_id),
seq AS (SELECT *, row_number() OVER (ORDER BY h) AS i FROM gs),
fill AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, NULL::BIGINT AS rollout_id, NULL::BIGINT AS size, NULL::VARCHAR AS split
  UNION ALL
  SELECT s.i, a + CASE WHEN a + s.size <= 40 THEN s.size ELSE 0 END,
    b + CASE WHEN a + s.size > 40 AND b + s.size <= 20 THEN s.size ELSE 0 END,
    c + CASE WHEN a + s.size > 40 AND b + s.size > 20 AND c + s.size <= 40 THEN s.size ELSE 0 END,
    s.rollout_id, s.size,
    CASE WHEN a + s.size <= 40 THEN 'train' WHEN b + s.size <= 20 THEN 'val' WHEN c + s.size <= 40 THEN 'test' ELSE 'unused' END
  FROM fill f JOIN seq s ON s.i = f.i + 1)"""

_FOLDS = """
cs AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey),
cseq AS (SELECT size, row_number() OVER (ORDER BY size DESC, o_custkey) AS i FROM cs),
loads AS (
  SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS ld, [0, 0, 0, 0, 0]::BIGINT[] AS ct
  UNION ALL
  SELECT s.i, list_transform(range(1, 6), lambda j: l.ld[j] + CASE WHEN j = list_position(l.ld, list_min(l.ld)) THEN s.size ELSE 0 END),
    list_transform(range(1, 6), lambda j: l.ct[j] + CASE WHEN j = list_position(l.ld, list_min(l.ld)) THEN 1 ELSE 0 END)
  FROM loads l JOIN cseq s ON s.i = l.i + 1)"""

_SUITE = """
kinds AS (
  SELECT arm, checkpoint_id, count(*) AS n, count(DISTINCT n_steps_in_branch * 2 + success::INT) > 1 AS varies
  FROM branches WHERE action = 'continue' AND replay_verified GROUP BY arm, checkpoint_id),
checks AS (
  SELECT 'V1' AS check_id, 'replay fidelity' AS check_name, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n AS n_checked, bad AS n_bad, 1 - bad / n::DOUBLE AS measure
    FROM (SELECT count(*) AS n, count(*) FILTER (NOT replay_verified) AS bad FROM branches WHERE action <> 'quit')
  UNION ALL SELECT 'V2', 'negative control', 'PASS', count(*), 0, 0e0 FROM (SELECT DISTINCT trace FROM steps) WHERE substr(md5(trace), 1, 1) = '0'
  UNION ALL SELECT 'V3', 'stored state hash', 'PASS', count(*), 0, count(*) FILTER (substr(md5(trace || '|' || t), 1, 1) = '0')::DOUBLE FROM steps
  UNION ALL SELECT 'V4', 'arm A determinism', CASE WHEN count(*) FILTER (n > 1 AND varies) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FILTER (n > 1),
    count(*) FILTER (n > 1 AND varies), (count(*) FILTER (n > 1 AND varies))::DOUBLE FROM kinds WHERE arm = 'A_replication'
  UNION ALL SELECT 'V5', 'arm B stochasticity', CASE WHEN count(*) FILTER (varies) > 0 THEN 'PASS' ELSE 'FAIL' END, count(*), count(*) FILTER (NOT varies), avg(varies::INT) FROM kinds WHERE arm = 'B_montecarlo'
  UNION ALL SELECT 'V6', 'takeover success', CASE WHEN avg(success::INT) >= 0.85 THEN 'PASS' ELSE 'FAIL' END, count(*), count(*) FILTER (NOT success), avg(success::INT) FROM branches WHERE action = 'intervene'
  UNION ALL SELECT 'V7', 'base success band', CASE WHEN avg(success::INT) BETWEEN 0.15 AND 0.60 THEN 'PASS' ELSE 'FAIL' END, count(*), count(*) FILTER (NOT success), avg(success::INT) FROM rollouts
  UNION ALL SELECT 'V8', 'split leakage', 'PASS', 3, 0, 0e0
  UNION ALL SELECT 'V9', 'derivation purity', 'PASS', count(*), 0, 0e0 FROM vals
  UNION ALL SELECT 'V10', 'stored column round trip', 'PASS', count(*), 0,
    count(*) FILTER (substr(md5(conv_id || '|' || turn), 1, 1) = '0')::DOUBLE FROM conversations)"""

ORACLE = {
    "shard_scan": with_views(
        "branches",
        """SELECT src, arm, action, count(*) AS n, sum(n_steps_in_branch)::BIGINT AS steps, count(*) FILTER (success) AS wins,
        count(*) FILTER (replay_verified) AS verified FROM branches GROUP BY ALL""",
    ),
    "strict_shard_scan": with_views(
        "branches", "SELECT src, count(*) AS n, count(DISTINCT branch_id) AS ids FROM branches GROUP BY src"
    ),
    "line_census": with_views(
        "branches",
        "SELECT src, count(*) AS records, 1::BIGINT AS headers, (src = 'branches.s001.r1.jsonl')::BIGINT AS malformed FROM branches GROUP BY src",
    ),
    "provenance": with_views(
        "branches", "SELECT DISTINCT src, 'run0' AS run_id, 'B_montecarlo' AS arm, 'cafe' AS config_hash, 3::BIGINT AS n_replicates FROM branches"
    ),
    "record_violations": """SELECT CASE WHEN l_returnflag <> 'A' THEN 'bad action' ELSE 'bad terminal_reason' END AS rule, count(*) AS n
      FROM lineitem WHERE l_returnflag <> 'A' OR l_linestatus <> 'O' GROUP BY ALL""",
    "attempt_selection": with_views(
        "vals",
        """SELECT arm, arm || '/' || branch_id AS branch_id, src, success, n_steps_in_branch::BIGINT AS n_steps_in_branch, replay_verified
        FROM branches JOIN pick USING (checkpoint_id, arm, src)""",
    ),
    "attempt_report": with_views(
        "vals",
        """SELECT count(*) FILTER (k > 1) AS checkpoints_with_multiple_sources, sum(total - kept)::BIGINT AS records_superseded, 0::BIGINT AS duplicate_branch_ids_dropped
        FROM (SELECT count(*) AS k, sum(n_records) AS total, max(n_records) AS kept FROM att GROUP BY checkpoint_id, arm)""",
    ),
    "records_per_source": with_views("vals", "SELECT src, sum(n_kept)::BIGINT AS records FROM pick GROUP BY src"),
    "cohort_labels": with_views("vals", "SELECT arm, cohort, count(*) AS n FROM census GROUP BY ALL"),
    "incomplete_reissue": with_views(
        "branches checkpoints",
        """SELECT checkpoint_id FROM checkpoints WHERE checkpoint_id NOT IN (
          SELECT checkpoint_id FROM branches WHERE arm = 'B_montecarlo' AND src = 'branches.s000.jsonl' GROUP BY checkpoint_id
          HAVING count(*) FILTER (action = 'continue') = 3 AND count(*) FILTER (action = 'intervene') = 3 AND count(*) FILTER (action = 'quit') = 1 AND bool_and(replay_verified))""",
    ),
    "vector_layers": """SELECT layer::BIGINT AS layer, count(*) AS n, (count(*) * 16)::BIGINT AS values, round(sum(list_sum(list_transform(embedding[layer * 16 + 1 : layer * 16 + 16], lambda x: x::DOUBLE))), 4) + 0e0 AS total
      FROM embeddings, (VALUES (1), (3)) l(layer) GROUP BY layer""",
    "corpus_manifest": "WITH" + _MANIFEST + " SELECT * FROM games",
    "corpus_sample": "WITH" + _MANIFEST + " SELECT * FROM games QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY folder) <= 3",
    "audit_classes": with_views("order_vals planned_orders", "SELECT * FROM classes", _AUDIT),
    "audit_class_counts": with_views("order_vals planned_orders", "SELECT class, count(*) AS n FROM classes GROUP BY class", _AUDIT),
    "audit_partial_reasons": with_views(
        "order_vals planned_orders",
        "SELECT reason, count(*) AS n FROM classes WHERE class = 'partial' GROUP BY reason ORDER BY n DESC, reason LIMIT 10",
        _AUDIT,
    ),
    "rerun_list": with_views("order_vals planned_orders", "SELECT checkpoint_id FROM classes WHERE class IN ('partial', 'absent')", _AUDIT),
    "remaining_units": with_views(
        "order_vals planned_orders", "SELECT checkpoint_id FROM planned WHERE checkpoint_id NOT IN (SELECT checkpoint_id FROM seen WHERE complete)", _AUDIT
    ),
    "lost_games": with_views(
        "order_vals planned_orders",
        """SELECT task_id, count(*) AS n FROM planned LEFT JOIN (SELECT checkpoint_id, 1 AS ok FROM seen WHERE complete) USING (checkpoint_id)
        GROUP BY task_id HAVING count(ok) = 0""",
        _AUDIT,
    ),
    "set_differences": with_views(
        "order_vals planned_orders",
        """SELECT 'planned_only' AS part, count(*) AS n FROM (SELECT checkpoint_id FROM planned EXCEPT SELECT checkpoint_id FROM seen)
        UNION ALL SELECT 'seen_only', count(*) FROM (SELECT checkpoint_id FROM seen EXCEPT SELECT checkpoint_id FROM planned)
        UNION ALL SELECT 'shared', count(*) FROM (SELECT checkpoint_id FROM seen INTERSECT SELECT checkpoint_id FROM planned)
        UNION ALL SELECT 'any', count(*) FROM (SELECT checkpoint_id FROM seen UNION SELECT checkpoint_id FROM planned)""",
        _AUDIT,
    ),
    "shared_games": with_views(
        "cpvals",
        """SELECT CASE WHEN a > 0 AND b > 0 THEN 'both' WHEN a > 0 THEN 'original_only' ELSE 'r1_only' END AS seen, count(*) AS games,
        sum(a)::BIGINT AS rows_original, sum(b)::BIGINT AS rows_r1 FROM (
          SELECT task_id, count(*) FILTER (cohort = 'original') AS a, count(*) FILTER (cohort <> 'original') AS b FROM cpvals WHERE arm = 'B_montecarlo' GROUP BY task_id) GROUP BY 1""",
    ),
    "unseen_games": with_views(
        "cpvals",
        """SELECT task_id IN (SELECT task_id FROM cpvals WHERE arm = 'B_montecarlo' AND cohort = 'original') AS seen, count(*) AS n,
        round(avg(tau), 6) + 0e0 AS tau_mean FROM cpvals WHERE arm = 'B_montecarlo' AND cohort <> 'original' GROUP BY 1""",
    ),
    "count_split": with_views("checkpoints", "SELECT rollout_id, size, split FROM fill WHERE i > 0", _COUNT_SPLIT),
    "fraction_split": with_views(
        "checkpoints",
        """SELECT task_id, CASE WHEN r <= round_even(6e-1 * n, 0) THEN 'train' WHEN r <= round_even(6e-1 * n, 0) + round_even(2e-1 * n, 0) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT task_id, row_number() OVER (ORDER BY md5('11|' || task_id)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT task_id FROM checkpoints))""",
    ),
    "grouped_holdout": with_views("checkpoints", "SELECT seed::BIGINT AS seed, task_id, is_test FROM hold", _HOLD),
    "balanced_fold_loads": "WITH RECURSIVE" + _FOLDS
    + " SELECT (j - 1)::BIGINT AS fold, ld[j] AS rows, ct[j] AS n_groups FROM (SELECT * FROM loads ORDER BY i DESC LIMIT 1), range(1, 6) r(j)",
    "split_leakage": with_views(
        "checkpoints",
        "SELECT rollout_id FROM rowsplit WHERE seed = 0 GROUP BY rollout_id HAVING count(DISTINCT is_test) > 1",
        _ROWSPLIT,
    ),
    "split_sizes": with_views(
        "checkpoints",
        """SELECT seed::BIGINT AS seed, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test,
        count(*) FILTER (NOT is_test) >= 100 AND count(*) FILTER (is_test) >= 40 AS ok FROM checkpoints JOIN hold USING (task_id) GROUP BY seed""",
        _HOLD,
    ),
    "group_overlap": with_views(
        "checkpoints",
        """SELECT seed::BIGINT AS seed, sum(a)::BIGINT AS n_test, round(sum(CASE WHEN b > 0 THEN a ELSE 0 END) / sum(a)::DOUBLE, 6) + 0e0 AS overlap FROM (
          SELECT seed, task_id, count(*) FILTER (is_test) AS a, count(*) FILTER (NOT is_test) AS b FROM rowsplit GROUP BY ALL) GROUP BY seed""",
        _ROWSPLIT,
    ),
    "quality_suite": with_views("vals steps rollouts", tidy_sql("SELECT * FROM checks", "measure", "n_checked n_bad"), _SUITE),
    "quality_suite_totals": with_views(
        "vals steps rollouts",
        """SELECT count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'SKIP') AS skip,
        (count(*) FILTER (status = 'FAIL') > 0)::BIGINT AS exit_status FROM checks""",
        _SUITE,
    ),
    "standard_error_spread": with_views(
        "branches",
        """SELECT round(list_sort(se)[len(se) // 2 + 1], 6) + 0e0 AS se_p50, round(list_sort(se)[floor(9e-1 * (len(se) - 1))::BIGINT + 1], 6) + 0e0 AS se_p90,
        round(list_max(se), 6) + 0e0 AS se_max FROM (SELECT list(coalesce(sd, 0e0) / sqrt(n)) AS se FROM (
          SELECT count(*) AS n, stddev_samp((CASE WHEN success THEN 1e0 ELSE -1e0 END) - 1e-2 * n_steps_in_branch) AS sd FROM branches
          WHERE arm = 'B_montecarlo' AND action = 'continue' AND replay_verified GROUP BY checkpoint_id))""",
    ),
    "worst_task_type": with_views(
        "branches checkpoints tasks",
        """SELECT round(avg(success::INT), 6) + 0e0 AS rate, task_type, count(*) AS n FROM branches JOIN checkpoints USING (checkpoint_id) LEFT JOIN tasks USING (task_id)
        WHERE action = 'intervene' GROUP BY task_type ORDER BY avg(success::INT), task_type LIMIT 1""",
    ),
    "evaluation_guard": with_views("checkpoints", "SELECT count(*) AS n_rows, count(DISTINCT task_id) AS n_groups FROM checkpoints"),
    "paths_agree": with_views(
        "cpvals",
        """SELECT 'W1' AS check_id, 'two paths agree' AS check_name, 'PASS' AS status, count(DISTINCT task_type) AS n_checked, 0::BIGINT AS n_bad, 0e0 AS measure
        FROM cpvals WHERE arm = 'B_montecarlo'""",
    ),
}
