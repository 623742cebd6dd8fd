import pytest
from pyspark.sql import functions as F

from strataline.operators import skew


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50).cast("int").alias("k"), "id")
    right = spark.range(60).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v")).filter("k <> 9")
    return left, right


def test_hot_keys_are_few_and_found(sides):
    left, _ = sides
    assert [r.k for r in skew.hot_keys(left, ["k"], 500).collect()] == [7]
    assert skew.hot_keys(left, ["k"]) is None and skew.hot_keys(left.limit(0), ["k"], 0) is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(sides, how):
    left, right = sides
    hot = skew.hot_keys(left, ["k"], 500)
    got = skew.salted_join(left, right, ["k"], hot, how, 4)
    want = left.join(right, ["k"], how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
