import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from branchwise.functions import ids as I
from branchwise.functions.ordered import exact_positions, exact_quantiles, hash_numbered, numbered, previous, running_sums


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"smooth": rng.normal(size=1501), "one": np.array([4.0]), "ties": np.repeat([1.0, 2.0, 2.5], [700, 1, 900]), "spiky": np.concatenate([rng.normal(size=300) * 1e-9, [1e12]])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = [0.0, 0.025, 0.1, 0.5, 0.9, 0.975, 1.0]
    for r in exact_quantiles(df, ["k"], "v", probs).collect():
        assert r["quantile"] == pytest.approx(float(np.quantile(groups[r["k"]], r["prob"])), rel=1e-12, abs=1e-15)
    assert exact_quantiles(df, ["k"], "v", probs).count() == len(groups) * len(probs)


def test_quantiles_of_many_rows_beyond_the_sketch(spark):
    df = spark.range(200001).select(F.pmod(F.col("id") * 7919, F.lit(200001)).cast("double").alias("v"))
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, [], "v", [0.1, 0.25, 0.999]).collect()}
    assert got == pytest.approx({0.1: 20000.0, 0.25: 50000.0, 0.999: 199800.0})


def test_nearest_positions(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    n = F.col("_n")
    got = {r["prob"]: r["quantile"] for r in exact_positions(df, [], "v", {0.5: F.floor(n / 2), 0.9: F.floor(F.lit(0.9) * (n - 1))}).collect()}
    assert got == {0.5: 5.0, 0.9: 8.0}


def test_block_numbering_equals_row_number(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), "id")
    got = numbered(df, ["k"], F.floor(F.col("v") / 50), ["v", "id"], "pos", "total")
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")))
    j = got.join(want.select("id", "w"), "id")
    assert j.where("pos <> w").count() == 0 and j.count() == 500
    assert got.where("k = 0").select("total").distinct().collect()[0][0] == 167


def test_hash_order_is_a_permutation(spark):
    df = spark.range(300)
    a = [r["id"] for r in hash_numbered(df, [], 1, "id", "pos").orderBy("pos").collect()]
    b = [r["id"] for r in df.orderBy(I.order_hash(1, F.col("id"))).collect()]
    assert a == b and sorted(a) == list(range(300))


def test_running_sums_and_lag_across_blocks(spark):
    df = spark.range(1, 101).select(F.lit("x").alias("k"), F.col("id").alias("t"), (F.col("id") % 5).alias("v"))
    got = running_sums(df, ["k"], "t", {"s": F.col("v")}, block_size=7).orderBy("t").collect()
    assert [r["s"] for r in got] == list(np.cumsum([i % 5 for i in range(1, 101)]))
    lag = previous(df, ["k"], "t", ["v"]).orderBy("t").collect()
    assert lag[0]["prev_v"] is None and [r["prev_v"] for r in lag[1:]] == [i % 5 for i in range(1, 100)]


def test_hashes(spark):
    import hashlib

    df = spark.createDataFrame([("abc", 5)], "s string, n int")
    r = df.select(
        I.text_hash(F.col("s")).alias("h"),
        I.derive_seed(F.col("s"), F.col("n"), "cp").alias("seed"),
        I.stable_hash({"b": F.col("n"), "a": F.col("s")}).alias("one"),
        I.stable_hash({"a": F.col("s"), "b": F.col("n")}).alias("two"),
    ).first()
    assert r["h"] == hashlib.sha256(b"abc").hexdigest()[:16]
    assert r["seed"] == int(hashlib.sha256(b"abc|5|cp").hexdigest()[:8], 16)
    assert r["one"] == r["two"] == hashlib.sha256(b'{"a":"abc","b":5}').hexdigest()[:16]


def test_state_signature_ignores_list_order(spark):
    df = spark.createDataFrame([(["b", "a"], [" f2", "f1 "]), (["a", "b"], ["f1", "f2"])], "c array<string>, f array<string>")
    sig = I.state_signature(F.lit(" o "), F.col("c"), F.lit(None).cast("double"), F.lit(None).cast("boolean"), F.lit(True), F.col("f"))
    assert df.select(I.signature_hash(sig)).distinct().count() == 1


def test_hash_blocks_follow_the_row_count(spark):
    """Positions do not depend on how finely the hash order is cut, and no block outgrows its size."""
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("k")).withColumn("k", F.when(F.col("id") < 1000, 0).otherwise(F.col("k")))
    for keys in ([], ["k"]):
        whole = {tuple(r) for r in hash_numbered(df, keys, 5, "id", "at").select("id", "at").collect()}
        assert whole == {tuple(r) for r in hash_numbered(df, keys, 5, "id", "at", block_rows=20).select("id", "at").collect()}


def test_numbering_cuts_only_large_keys_and_keeps_null_ones(spark):
    """Keys of few rows are met whole in one exchange; cut keys and null keys are numbered alike."""
    key = F.when(F.col("id") % 7 == 0, None).when(F.col("id") < 300, 1).otherwise(F.col("id"))
    df = spark.range(500).select(key.alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), "id")
    w = Window.partitionBy("k").orderBy("v", "id")
    want = {tuple(r) for r in df.select("id", F.row_number().over(w), F.count("id").over(Window.partitionBy("k"))).collect()}
    for rows in (10, 10_000):
        got = numbered(df, ["k"], F.floor(F.col("v") / 50), ["v", "id"], "pos", "total", task_rows=rows)
        assert {tuple(r) for r in got.select("id", "pos", "total").collect()} == want
