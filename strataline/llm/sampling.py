"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, key: Column, size: int) -> DataFrame:
    """The rows of least key hash, about `size` of them and never more.

    Rows are first thinned out by hash to a quarter more than that, so that what tasks send on is bounded as well.
    """
    spread = 1 << 30
    rows = df.count()
    kept = spread if rows <= size else int(spread * min(1.0, 1.25 * size / rows)) + 1
    h = F.xxhash64(key)
    place = F.pmod(h, F.lit(spread))
    return df.filter(place < kept).orderBy(place, h).limit(size)
