"""Append-only line-delimited JSON shards.

A shard is a file or a folder whose name carries meaning: ``branches.s003.jsonl``
is an original run, ``branches.s003.rescue.jsonl`` a later attempt. Readers take
the whole folder and keep the shard name as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchwise.functions.outcomes import ACTIONS, ARMS, TERMINAL_REASONS
from branchwise.sources.schemas import PROVENANCE

CORRUPT, HEADER = "_corrupt", "__provenance__"


def shard_name(stem: str, shard: int | None = None, tag: str | None = None) -> str:
    """Name of a shard; a fresh tag per resume means no file is ever reopened."""
    parts = [stem]
    if shard is not None:
        parts.append(f"s{shard:03d}")
    if tag:
        parts.append(tag)
    return ".".join([*parts, "jsonl"])


def _shard_of(stem: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), rf"({stem}\.(?:[^/]*\.)?jsonl)", 1)


def scan(spark: SparkSession, root: str, stem: str, schema: T.StructType) -> DataFrame:
    """Every line of every shard: record columns, ``src``, the header and the damage column."""
    full = T.StructType(
        schema.fields + [T.StructField(HEADER, PROVENANCE), T.StructField(CORRUPT, T.StringType())]
    )
    raw = (
        spark.read.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", "true")
        .json(root)
    )
    return raw.withColumn("src", _shard_of(stem)).where(F.col("src") != "")


def read_records(spark: SparkSession, root: str, stem: str, schema: T.StructType) -> DataFrame:
    """Good records only: headers dropped, damaged lines skipped."""
    return scan(spark, root, stem, schema).where(F.col(HEADER).isNull() & F.col(CORRUPT).isNull()).drop(HEADER, CORRUPT)


def read_strict(spark: SparkSession, root: str, stem: str, schema: T.StructType) -> DataFrame:
    """Same, but the first damaged line fails the job."""
    full = T.StructType(schema.fields + [T.StructField(HEADER, PROVENANCE)])
    raw = spark.read.schema(full).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(root)
    return raw.withColumn("src", _shard_of(stem)).where((F.col("src") != "") & F.col(HEADER).isNull()).drop(HEADER)


def line_census(spark: SparkSession, root: str, stem: str, schema: T.StructType, id_col: str) -> DataFrame:
    """Records, headers and damaged lines per shard, counted once."""
    return (
        scan(spark, root, stem, schema)
        .groupBy("src")
        .agg(
            F.count_if(F.col(CORRUPT).isNull() & F.col(HEADER).isNull() & F.col(id_col).isNotNull()).alias("records"),
            F.count_if(F.col(HEADER).isNotNull()).alias("headers"),
            F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed"),
        )
    )


def read_provenance(spark: SparkSession, root: str, stem: str, schema: T.StructType) -> DataFrame:
    """One row per shard that carries a header, else none for it."""
    found = scan(spark, root, stem, schema).where(F.col(HEADER).isNotNull())
    return found.select("src", HEADER).groupBy("src").agg(F.min(F.struct(f"{HEADER}.*")).alias("p")).select("src", "p.*")


def header_line(run_id: str, arm: str, config_hash: str, **extra) -> Column:
    """Header record as one JSON line; the time stamp is the only clock value."""
    fields = [F.lit(run_id).alias("run_id"), F.lit(arm).alias("arm"), F.lit(config_hash).alias("config_hash")]
    fields += [F.lit(v).alias(k) for k, v in extra.items()]
    fields.append(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"))
    return F.to_json(F.struct(F.struct(*fields).alias(HEADER)))


def write_shards(lines: DataFrame, root: str) -> None:
    """Append (src, line) rows: one folder per shard, committed per task; JSON lines repeat their names, so files are gzipped."""
    lines.select("line", F.col("src").alias("shard")).write.mode("append").partitionBy("shard").text(root, compression="gzip")


def to_lines(df: DataFrame, src: str = "src") -> DataFrame:
    cols = sorted(c for c in df.columns if c != src)
    return df.select(F.col(src).alias("src"), F.to_json(F.struct(*cols)).alias("line"))


def violations(branches: DataFrame) -> DataFrame:
    """Rows breaking an enum or a required field, with the rule they break."""
    rule = (
        F.when(F.col("branch_id").isNull() | F.col("checkpoint_id").isNull(), "missing id")
        .when(F.col("arm").isNull() | ~F.col("arm").isin(*ARMS), "bad arm")
        .when(F.col("action").isNull() | ~F.col("action").isin(*ACTIONS), "bad action")
    )
    if "terminal_reason" in branches.columns:
        rule = rule.when(~F.col("terminal_reason").isin(*TERMINAL_REASONS), "bad terminal_reason")
    return branches.withColumn("rule", rule).where(F.col("rule").isNotNull())


def validated(branches: DataFrame) -> DataFrame:
    """Strict form: a bad arm, action or terminal reason fails the job."""

    def fail(name: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"bad {name}: "), F.coalesce(F.col(name), F.lit("null")))).cast("string")

    out = branches.withColumn("arm", F.when(F.col("arm").isin(*ARMS), F.col("arm")).otherwise(fail("arm")))
    out = out.withColumn("action", F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise(fail("action")))
    if "terminal_reason" in branches.columns:
        known = F.col("terminal_reason").isin(*TERMINAL_REASONS)
        out = out.withColumn("terminal_reason", F.when(known, F.col("terminal_reason")).otherwise(fail("terminal_reason")))
    return out


def append_missing(spark: SparkSession, planned: DataFrame, done: DataFrame, root: str, attempt: str) -> DataFrame:
    """Idempotent append: write only units not done, under a new attempt folder.

    Returns what was written. ``done`` must not come from the attempt being written, which its ``attempt`` column tells.
    """
    if "attempt" in done.columns and not done.where(F.col("attempt") == attempt).isEmpty():
        raise ValueError(f"units done in attempt {attempt} cannot decide what it writes")
    todo = planned.join(done.select("checkpoint_id").distinct(), "checkpoint_id", "left_anti")
    target = f"{root}/attempt={attempt}"
    todo.write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("errorifexists").format(fmt).save(path)


def markdown_lines(df: DataFrame, order: list) -> DataFrame:
    """Every row of a result as a Markdown table row, in order."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.orderBy(*order).select(
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")
    )


def write_id_list(ids: DataFrame, path: str) -> None:
    """Sorted id list as text; range-sorted in parallel, one part per range."""
    ids.select(F.col(ids.columns[0]).cast("string").alias("value")).orderBy("value").write.mode("errorifexists").text(path)
