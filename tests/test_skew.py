"""The sliced walks against plain windows, on data where one key holds most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import matching, skew


def hot(spark, n=4000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.col("id"), (F.hash("id") % 100).alias("v"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_positions(spark):
    df = hot(spark)
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy("id")).cast("long"))
    assert rows(skew.positions(df, ["k"], [F.col("id")], F.floor(F.col("id") / 100))) == rows(want)


def test_positions_without_slices(spark):
    df = hot(spark)
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")).cast("long"))
    assert rows(skew.positions(df, ["k"], [F.col("v"), F.col("id")])) == rows(want)


def test_previous_keeps_nulls(spark):
    df = hot(spark).withColumn("x", F.when(F.col("v") > 0, F.col("v")))
    want = df.withColumn("p", F.lag("x").over(Window.partitionBy("k").orderBy("id")))
    assert rows(skew.previous(df, ["k"], [F.col("id")], F.floor(F.col("id") / 64), F.col("x"), "p")) == rows(want)


def test_running_sum_and_min(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    for how in (F.sum, F.min):
        want = df.withColumn("r", how("v").over(w).cast("long"))
        got = skew.running(df, ["k"], [F.col("id")], F.floor(F.col("id") / 100), F.col("v"), "r", how=how).withColumn("r", F.col("r").cast("long"))
        assert rows(got) == rows(want)


def test_pick(spark):
    df = hot(spark)
    want = {k: i for k, i in df.groupBy("k").agg(F.max("id")).collect()}
    assert {r["k"]: r["id"] for r in skew.pick(df, ["k"], F.col("id")).collect()} == want


def test_containment_against_brute_force(spark):
    left = ["", "a", "ab", "NATION_1", "NATION_12", "xNATION_1y", "ATI"]
    right = ["a", "N", "NATION_1", "ION_12", "zz", "", "NATION_12"]
    got = matching.contained_pairs(spark.createDataFrame([(x,) for x in left], "s string"), spark.createDataFrame([(x,) for x in right], "s string"))
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in left for b in right if a and b and b in a}
