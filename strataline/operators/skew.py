"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with over a 1 / MOST of the rows (and LEAST at least), so there are at most MOST hot keys.
MOST, LEAST = 1000, 50_000
SALTS = 32


def hot_keys(df: DataFrame, keys: list[str], least: int = LEAST, weight: str | None = None) -> DataFrame | None:
    """The keys that hold over 1 / MOST of the rows of df, hence at most MOST of them; None where there are none.

    With weight, a row stands for so many. Counts are added up before they are shuffled. Null keys are left out, as
    they meet nothing in a join.
    """
    size = F.sum(weight) if weight else F.count("*")
    n = df.agg(size).first()[0] or 0
    if n <= least:
        return None
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = df.filter(known).groupBy(*keys).agg(size.alias("_n")).filter(F.col("_n") > max(least, n // MOST)).select(*keys).collect()  # MOST rows at most
    return df.sparkSession.createDataFrame(rows, df.select(*keys).schema) if rows else None


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """left joined to right on keys (inner, left, left_semi, left_anti), the rows of left with a hot key spread over `salts` tasks.

    hot: of hot_keys(left, keys). right is the side with few rows a key; those of hot keys go to every salt. Columns are
    those of a plain join. The salt is a hash of the row, so a task that runs again sends its rows the same way.
    """
    if hot is None:
        return left.join(right, keys, how)
    mark = F.broadcast(hot.distinct().withColumn("_hot", F.lit(True)))  # MOST rows at most
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(0)
    spread = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    a = left.join(mark, keys, "left").withColumn("_salt", salt).drop("_hot")
    b = right.join(mark, keys, "left").withColumn("_salt", spread).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
