"""The study table: values, observables and vectors side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchwise.functions.outcomes import ARM_B, action_index
from branchwise.functions.text import TASK_TYPES
from branchwise.operators import linear as L
from branchwise.plans import views
from branchwise.plans.common import full_values
from branchwise.plans.views import table
from branchwise.session import stored

SEEDS = [0, 1, 2, 3, 4]
OBS = ["t", "progress", "n_steps", "conf", "size", "price"] + [f"is_{k}" for k in TASK_TYPES[:6]]
N_OBS, N_VEC = len(OBS), 64
OBS_IX = tuple(range(1, 1 + N_OBS))
VEC_IX = tuple(range(1 + N_OBS, 1 + N_OBS + N_VEC))
QC_IX, QI_IX, TAU_IX = (1 + N_OBS + N_VEC + i for i in range(3))
LAYERS = 4
LAYER_IX = [VEC_IX[i * 16 : (i + 1) * 16] for i in range(LAYERS)]


def base_rows(spark, sf) -> DataFrame:
    """Arm B checkpoints with values and the observable features as columns."""
    v = full_values(spark, sf).where(F.col("arm") == ARM_B)
    cols = {
        "t": F.col("t").cast("double"),
        "progress": F.coalesce("progress", F.lit(0.0)),
        "n_steps": F.coalesce(F.col("n_steps").cast("double"), F.lit(0.0)),
        "conf": F.coalesce("confidence", F.lit(0.5)),
        "size": F.col("size"),
        "price": F.col("price") / 1000.0,
    }
    cols |= {f"is_{k}": (F.col("task_type") == k).cast("double") for k in TASK_TYPES[:6]}
    return v.select(
        "checkpoint_id",
        "part_id",
        "task_id",
        "rollout_id",
        "task_type",
        "cohort",
        "s_continue",
        "p_fail_continue",
        "p_success_continue",
        F.col("value_continue").alias("qc"),
        F.col("value_intervene").alias("qi"),
        "tau",
        "oracle_action",
        action_index(F.col("oracle_action")).cast("int").alias("oracle_ix"),
        F.array(*[cols[c] for c in OBS]).alias("obs"),
    )


def study_rows(spark, sf, group: str = "task_id", seeds=SEEDS, restrict=None) -> DataFrame:
    """Rows with ``z`` and the fold of every seed; written once, then scanned per use."""
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("part_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec")
    )
    # Fixture rule: a part has the vector of its id modulo the number of vectors, so every checkpoint has one.
    n = e.count()
    e = e.withColumnRenamed("part_id", "vec_id")
    rows = base_rows(spark, sf).join(e, F.pmod("part_id", F.lit(n)) == F.col("vec_id")).drop("vec_id")
    if restrict is not None:
        rows = rows.where(restrict)
    one = F.array(F.lit(1.0))
    rows = rows.withColumn("z", F.concat(one, "obs", "vec", F.array("qc", "qi", "tau"))).drop("obs", "vec")
    rows = stored(rows, "study")
    return rows.join(L.seed_folds(rows, group, list(seeds)), group)


#: Class targets and their numbers of classes.
CLASSES = {"continue_success": 2, "oracle_ix": 3}


def with_classes(rows) -> DataFrame:
    """The class targets as whole numbers: whether continuing mostly succeeds, and the best action."""
    return rows.withColumn("continue_success", (F.col("p_success_continue") > 0.5).cast("int"))


def scheme_rows(spark, sf) -> DataFrame:
    """Study rows with the folds of every seed by game and then by rollout in one array, written once."""
    rows = with_classes(study_rows(spark, sf))
    by_rollout = L.seed_folds(rows, "rollout_id", SEEDS).withColumnRenamed("folds", "more")
    rows = rows.join(by_rollout, "rollout_id").withColumn("folds", F.concat("folds", "more"))
    return stored(rows.select("z", "folds", *CLASSES), "schemes")


SCHEMES = ("held_out_game", "grouped_by_rollout")


def scheme(ix) -> tuple:
    """(scheme, seed) of a place in the folds of ``scheme_rows``."""
    names = F.array(*[F.lit(s) for s in SCHEMES])
    return F.element_at(names, (F.floor(ix / len(SEEDS)) + 1).cast("int")).alias("scheme"), F.pmod(ix, F.lit(len(SEEDS))).alias("seed_ix")


def feature_blocks() -> dict[str, tuple[int, ...]]:
    blocks = {"observables": OBS_IX, "all_layers": VEC_IX, "obs_all": OBS_IX + VEC_IX}
    blocks |= {f"layer{i}": LAYER_IX[i] for i in range(LAYERS)}
    return blocks | {f"obs_layer{i}": OBS_IX + LAYER_IX[i] for i in range(LAYERS)}


VALUES = {"qc": QC_IX, "qi": QI_IX, "tau": TAU_IX}


def battery() -> list[L.Model]:
    """Three targets times eleven feature blocks."""
    return [L.Model(f"{t}|{b}", f, ix) for t, ix in VALUES.items() for b, f in feature_blocks().items()]
