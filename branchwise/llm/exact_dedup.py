"""Exact duplicates, skew-safe: combine inside each input partition, merge salted digest groups, combine the salt winners.

DataFrame operations only. Every stage groups by the digest *and* the whole normalised text, so equality is always
decided on content; the digest only places rows. Copies inside one input partition become one row before any shuffle,
a group that fills the table meets as at most ``salts`` rows in the last stage, and no group is ever gathered.

Cases: null text is empty text. Rows with a null id count in their group and never stay unless all its ids are null.
A row repeated with the same id and text stays once. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchwise.llm.common import ascii_lower, whole_rows
from branchwise.session import stored

SALTS = 32


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest id stays. ``digest`` may be any function of the
    text: different texts that share a digest are told apart by their content.
    """
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.col(text_col)).alias("body"))
    sha = F.sha2(F.encode("body", "UTF-8"), 256)
    rows = body.withColumn("text_sha256", sha)
    rows = rows.withColumn("digest", F.col("text_sha256") if digest is None else digest(F.col("body")).cast("string"))
    local = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    merged = (
        local.repartition("digest")
        .groupBy("digest", "body")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    # A digest with one text needs that text no more; only colliding digests keep theirs.
    winners = stored(
        merged.groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("texts"),
            F.max("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
        ),
        "exact-winners",
    )
    out = _placed(rows.groupBy("doc_id", "digest", "text_sha256"), winners.where("texts = 1"), ["digest"])
    if not winners.where("texts > 1").isEmpty():
        clash = merged.join(winners.where("texts > 1").select("digest"), "digest", "left_semi")
        more = rows.join(winners.where("texts > 1").select("digest"), "digest", "left_semi")
        out = out.unionByName(_placed(more.groupBy("doc_id", "digest", "text_sha256", "body"), clash, ["digest", "body"]))
    return out


def _placed(grouped, winners: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's winner. Rows alike in id and text are counted first and written back one by one, so
    that exactly one of them stays."""
    rows = grouped.agg(F.count(F.lit(1)).alias("times"))
    return (
        rows.join(winners.select(*keys, "keep_id", "group_size"), keys)
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged, whatever their names.

    A row alike in id and text to the one that stays is dropped too; texts move again only where there are such rows."""
    id_, sha = F.col(id_col).cast("long").alias("id"), F.sha2(F.encode(ascii_lower(F.col(text_col)), "UTF-8"), 256).alias("sha")
    rows = docs.select(id_, sha, whole_rows(docs))
    keep = exact_groups(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    keep = stored(keep.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("times")), "exact-kept")

    def of(part: DataFrame) -> DataFrame:
        return rows.join(part, rows["id"].eqNullSafe(part["id"]) & (rows["sha"] == part["sha"]), "left_semi")

    out = of(keep.where("times = 1")).select("row.*")
    again = keep.where("times > 1")
    return out if again.isEmpty() else out.unionByName(of(again).dropDuplicates(["id", "sha"]).select("row.*"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
           FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
