"""One row per key out of tables with repeated deliveries, without shuffling the wide columns where repeats are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import cut_lineage

#: Repeated keys that are broadcast at most; with more the rows themselves are shuffled.
FEW = 100_000


def one_per_key(df: DataFrame, key: str, order: str, columns: list[str] | None = None, last: bool = False) -> DataFrame:
    """key, order and the columns (all by default) of the row of each key that comes first (or last) by order.

    Only key and order are aggregated; the keys that occur more than once are looked up by broadcast while they are at
    most FEW, which is counted. With more of them, or where a key repeats a value of order or has a null one, whole rows
    are compared: ties go to the least (or largest) row, null orders count as the least. Null keys count as one key.
    """
    rest = [c for c in (columns or df.columns) if c not in (key, order)]
    best = F.max if last else F.min
    counts = df.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(order).alias("places"), best(order).alias("_best")).filter("n > 1")
    again = cut_lineage(counts)
    told = again.agg(F.count("*").alias("keys"), F.sum((F.col("places") < F.col("n")).cast("int")).alias("ties")).first()
    if told["keys"] == 0:
        return df.select(key, order, *rest)
    if told["keys"] > FEW or told["ties"]:
        return df.groupBy(key).agg(best(F.struct(order, *rest)).alias("r")).select(key, f"r.{order}", *[f"r.`{c}`" for c in rest])
    few = F.broadcast(again.select(F.col(key).alias("_key"), "_best"))  # FEW rows at most
    return df.join(few, df[key].eqNullSafe(few["_key"]), "left").filter(F.col("_best").isNull() | (F.col(order) == F.col("_best"))).select(key, order, *rest)
