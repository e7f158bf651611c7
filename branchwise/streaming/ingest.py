"""Incremental ingest of appended shards with running completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchwise.functions.outcomes import ACTIONS, QUIT

KEY = ["checkpoint_id", "arm", "src"]


def shard_stream(spark: SparkSession, root: str, stem: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Good records of every shard file as it appears; damaged lines and headers are dropped."""
    full = T.StructType(
        schema.fields + [T.StructField("__provenance__", T.StringType()), T.StructField("_corrupt", T.StringType())]
    )
    raw = (
        spark.readStream.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(root)
    )
    src = F.regexp_extract(F.col("_metadata.file_path"), rf"({stem}\.(?:[^/]*\.)?jsonl)", 1)
    good = raw.withColumn("src", src).where((F.col("src") != "") & F.col("__provenance__").isNull() & F.col("_corrupt").isNull())
    return good.drop("__provenance__", "_corrupt")


def running_counts(records: DataFrame) -> DataFrame:
    """Counts per (checkpoint, arm, attempt); repeated branch ids count once."""
    return batch_counts(records.dropDuplicates([*KEY, "branch_id"]))


def batch_counts(once: DataFrame) -> DataFrame:
    """Counts per (checkpoint, arm, attempt) of records that occur once."""
    verified = F.coalesce("replay_verified", F.lit(False))
    return once.groupBy(*KEY).agg(
        *[F.sum(F.when(F.col("action") == a, 1).otherwise(0)).alias(f"n_{a}") for a in ACTIONS],
        F.sum(F.when((F.col("action") != QUIT) & ~verified, 1).otherwise(0)).alias("n_unverified"),
    )


def ingest(records: DataFrame, out: str, checkpoint: str) -> int:
    """Append every new record and the counts it adds, and stop. Returns how many records were read.

    Below ``out``, ``records`` is the table of records and ``counts`` holds the counts that each batch adds, one folder per
    batch id, written over if the batch is repeated. A branch id repeats itself only in its own shard, so ids are looked up
    among earlier batches' records of the same shards, in the table itself: no state grows in memory, and new shards look up
    nothing. Older counts and the other columns of older records are not read again.
    """
    ids = [*KEY, "branch_id"]

    def add(batch: DataFrame, number: int) -> None:
        spark, path = batch.sparkSession, f"{out}/records/batch={number}"
        # Rows move once: copies and counts are of one checkpoint.
        batch.repartition("checkpoint_id").dropDuplicates(ids).write.mode("overwrite").partitionBy("src").parquet(path)
        done = read_batch(spark, path, batch)
        shards = [r["src"] for r in done.select("src").distinct().collect()]
        before = spark.read.schema(done.schema.add("batch", "long")).option("basePath", f"{out}/records").parquet(f"{out}/records")
        again = repeats(done, before.where((F.col("batch") < number) & F.col("src").isin(shards)), ids)
        if again is not None:
            fresh = f"{out}/fresh/batch={number}"
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ids]
            done.alias("a").join(again.alias("b"), same, "left_anti").write.mode("overwrite").partitionBy("src").parquet(fresh)
            read_batch(spark, fresh, batch).write.mode("overwrite").partitionBy("src").parquet(path)
            done = read_batch(spark, path, batch)
        batch_counts(done).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    q = records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)


def read_batch(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A written batch with the columns of the batch itself, also where it holds no row."""
    return spark.read.schema(like.schema).parquet(path)


def repeats(rows: DataFrame, before: DataFrame, ids: list[str]) -> DataFrame | None:
    """The ids of ``rows`` that occur in ``before``, or none. Hashes meet first, so that ids move only where some may repeat."""
    mark = F.xxhash64(*ids).alias("mark")
    if before.isEmpty():
        return None
    marks = rows.select(mark).join(before.select(mark), "mark", "left_semi").distinct()
    if marks.isEmpty():
        return None
    # Ids with nulls are ids too.
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ids]
    maybe = rows.select(*ids, mark).join(marks, "mark", "left_semi").alias("a")
    old = before.select(*ids, mark).join(marks, "mark", "left_semi").alias("b")
    return maybe.join(old, [F.col("a.mark") == F.col("b.mark"), *same], "left_semi").drop("mark")


def current_counts(spark: SparkSession, out: str) -> DataFrame:
    """Counts per key over all records ingested so far: the batches' counts added up."""
    counts = spark.read.parquet(f"{out}/counts")
    return counts.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in counts.columns if c.startswith("n_")])


def missing_units(planned: DataFrame, counts: DataFrame, n_replicates: int) -> DataFrame:
    """Planned checkpoints without a complete attempt so far."""
    full = counts.where(
        (F.col("n_continue") == n_replicates) & (F.col("n_intervene") == n_replicates) & (F.col("n_quit") == 1) & (F.col("n_unverified") == 0)
    )
    return planned.join(full.select("checkpoint_id").distinct(), "checkpoint_id", "left_anti")
