"""Mixing sources to target weights by exact cuts in a random order.

Each row gets a hash-random key. Rows of a source are sorted in ranges of that key (one range is one block, so a hot
source is many blocks), block totals give each block's start, and running sums inside a block give every row's place in
the source's running size. A target of q whole epochs and a rest takes every row q times and cuts the next epoch where
the running size reaches the rest: the taken words of a source are its target, rounded.

Cases: null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; rows alike in
all columns are rows of their own; an empty table gives an empty result. Runs agree: keys are hashes of id and seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from branchwise.llm.common import whole_rows
from branchwise.session import stored

WEIGHTS, MOST_EPOCHS, SEED, BLOCK_ROWS = (1, 2, 3), 3, 17, 2048
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size) rows. One row per source leaves the first aggregate.

    Sources by code point, null last, weigh ``weights`` in turn and share the total; a share above ``most_epochs``
    times the source's size stops there, and the excess is shared again by weight until none is above.
    """
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    table = stored(totals.withColumn("weight", weight).withColumn("cap", F.lit(float(most_epochs)) * F.col("source_size")), "mix-weights")
    # A source is at its cap when cap <= rate * weight; raising the rate to share the rest can only add such sources.
    rate, full = 0.0, -1
    while True:
        at_cap = F.col("cap") <= F.lit(rate) * F.col("weight")
        total, capped, free, n = table.agg(
            F.sum("source_size"),
            F.coalesce(F.sum(F.when(at_cap, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(at_cap, 1)),
        ).first()
        if not total or not free or n == full:
            break
        rate, full = (total - capped) / free, n
    return table.select("source", "source_size", F.least("cap", F.lit(rate) * F.col("weight")).alias("target"))


def mixed(rows: DataFrame, id_col: str, source_col: str, size_col: str, seed: int = SEED, weights=WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row."""
    r = rows.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size")
    )
    targets = source_targets(r, weights)
    n = r.count()
    bits = max(0, (n // BLOCK_ROWS).bit_length())
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    r = r.withColumn("key", key).withColumn("block", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    blocks = r.groupBy("source", "block").agg(F.sum("size").alias("in_block"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("source", "block", F.coalesce(F.sum("in_block").over(upto), F.lit(0)).alias("start"))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(
        starts["source"].alias("_source"), starts["block"].alias("_block"), "start", "source_size", "target"
    )
    inside = (
        Window.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = r.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = local.join(starts, local["source"].eqNullSafe(starts["_source"]) & (local["block"] == starts["_block"]))
    want = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long")
    rest = want - epochs * F.col("source_size") - F.col("start") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(rest, F.col("size")))
    return at.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _first_words(text, n) -> F.Column:
    """The first n words, joined by single spaces."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row as often as it is taken. A row cut by the budget comes once more with its first words,
    up to the cut, joined by single spaces; rows that are not taken do not come. Other columns are unchanged, whatever
    their names, but ``n_chars`` follows the text."""
    # The random key is drawn from id and text, so rows with one id are told apart; alike rows share what they take.
    key = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("key")
    sized = docs.select(key, F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), whole_rows(docs))
    rows = stored(sized.select("key", "source", "size"), "mix-sizes")
    got = mixed(rows, "key", "source", "size")
    per_key = got.groupBy("doc_id", "source").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("times"))
    joined = sized.join(per_key, (sized["key"] == per_key["doc_id"]) & sized["source"].eqNullSafe(per_key["source"]))
    joined = joined.select("key", "size", "taken", "times", "row")
    alone = joined.where("times = 1").withColumn("own", F.col("taken"))
    # Rows alike in id, text and source: all share evenly, the first ones one word more.
    alike = joined.where("times > 1")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("size"))
    alike = alike.withColumn("own", F.floor(F.col("taken") / F.col("times")) + (nth <= F.pmod("taken", "times")).cast("long"))
    both = alone.unionByName(alike).where("own > 0")
    copies = F.ceil(F.col("own") / F.col("size")).cast("long")
    out = both.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    out = out.withColumn("words", F.least(F.col("size"), F.col("own") - (F.col("nth") - 1) * F.col("size")))
    own = lambda c: F.col("row").getField(c)
    text, whole = own(text_col), F.col("words") == F.col("size")
    cut = F.when(whole, text).otherwise(_first_words(text, F.col("words")))
    out = out.select("row", cut.alias("cut"), whole.alias("whole"))
    length = lambda kind: F.when(F.col("whole"), own("n_chars")).otherwise(F.length("cut").cast(kind))
    made = {text_col: F.col("cut")} | ({"n_chars": length(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[made.get(c, own(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixed(stored(sized, "mix-sizes"), "doc_id", "source", "size").drop("source")
