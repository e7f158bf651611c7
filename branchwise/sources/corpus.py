"""Corpus manifest: a tree of folders with two JSON documents each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.operators.summaries import top_k_per_group

# File names and the path markers of excluded variants.
TRAJECTORY_FILE, GAME_FILE = "traj_data.json", "game.tw-pddl"
EXCLUDED_MARKERS = ("movable", "Sliced")


def write_tree(files: DataFrame, root: str) -> int:
    """Write (path, content) rows as files below a root on any storage that pyarrow reaches; returns their number."""
    import pyarrow as pa
    from pyarrow import fs

    def run(batches):
        store, base = fs.FileSystem.from_uri(root.replace("s3a://", "s3://") if "://" in root else root.removeprefix("file:"))
        n = 0
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = f"{base}/{path.lstrip('/')}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(target) as f:
                    f.write((content or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file below a root, listed and read in parallel."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def manifest(files: DataFrame, task_types: list[str] | None = None) -> DataFrame:
    """Solvable games with their task type.

    Each document is reduced to the one field needed before the two are paired, so
    the join moves folder names and flags, not documents.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    keep = files.select(folder.alias("folder"), name.alias("name"), "content")
    for marker in EXCLUDED_MARKERS:
        keep = keep.where(~F.col("folder").contains(marker))
    kinds = keep.where(F.col("name") == TRAJECTORY_FILE).select(
        "folder", F.get_json_object("content", "$.task_type").alias("task_type")
    )
    games = keep.where(F.col("name") == GAME_FILE).select(
        "folder", F.get_json_object("content", "$.solvable").alias("solvable")
    )
    out = games.where(F.col("solvable") == "true").join(kinds, "folder").where(F.col("task_type").isNotNull())
    if task_types:
        out = out.where(F.col("task_type").isin(*task_types))
    return out.select("folder", "task_type")


def sample_per_type(games: DataFrame, per_type: int) -> DataFrame:
    """First ``per_type`` games of each type in path order."""
    return top_k_per_group(games, "task_type", ["folder"], per_type)
