"""Dense vector store: one row per (id, layer), partitioned by layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_layers(wide: DataFrame, id_col: str, vec: str, n_layers: int, width: int) -> DataFrame:
    """Cut one long vector per id into numbered layers of equal width."""
    layers = F.array(
        *[
            F.struct(F.lit(i).alias("layer"), F.slice(F.col(vec), i * width + 1, width).alias("vec"))
            for i in range(n_layers)
        ]
    )
    return wide.select(F.col(id_col), F.explode(layers).alias("r")).select(id_col, "r.layer", "r.vec")


def write_store(long: DataFrame, path: str) -> None:
    long.write.mode("errorifexists").partitionBy("layer").parquet(path)


def load_layers(spark: SparkSession, path: str, layers: list[int]) -> DataFrame:
    """Only the folders of the chosen layers are listed and read."""
    return spark.read.parquet(path).where(F.col("layer").isin(*layers))


def aligned(rows: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Vectors of the rows that have one."""
    return rows.join(store, key)
