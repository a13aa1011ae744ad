"""Partitions under a bound of cost, by a two-level prefix sum.

Rows are dealt to buckets by a hash; running sums inside the buckets, and over their totals,
give every row its stretch on one line of costs. The line is cut at multiples of the bound: rows that
lie inside a cut share a partition, and a row across a border has one of its own. So no
partition costs more than the bound, unless a single row does, and there are at most about
twice as many as the costs ask for. Only the totals of the buckets, whose number is a parameter,
meet in one place.

Defined results: null and negative costs count as nothing; an empty table stays empty and
has one partition; rows may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def placed(df: DataFrame, cost: Column, bound: int, buckets: int = 1024, into: str = "partition") -> DataFrame:
    """``df`` with the number of the partition of each row, from 0; costs and their sum fit a bigint."""
    if bound < 1:
        raise ValueError("the bound must be at least 1")
    own = df.withColumn("_cost", F.greatest(F.coalesce(cost.cast("bigint"), F.lit(0)), F.lit(0)))
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    own = own.withColumn("_bucket", bucket)
    order = Window.partitionBy("_bucket").orderBy("_cost").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_upto", F.sum("_cost").over(order))
    totals = own.groupBy("_bucket").agg(F.sum("_cost").alias("t")).agg(F.array_sort(F.collect_list(F.struct("_bucket", "t"))).alias("ts"))
    before = totals.select(F.explode(F.transform("ts", lambda x: F.struct(x["_bucket"].alias("_bucket"), F.aggregate(F.filter("ts", lambda y: y["_bucket"] < x["_bucket"]), F.lit(0).cast("bigint"), lambda a, y: a + y["t"]).alias("_before")))).alias("b")).select("b.*")
    line = own.join(F.broadcast(before), "_bucket")
    stop = F.col("_before") + F.col("_upto")
    start = stop - F.col("_cost")
    first, last = F.floor(start / bound), F.floor(F.greatest(stop - 1, start) / bound)
    return line.withColumn(into, F.when(first == last, 2 * first).otherwise(2 * first + 1)).drop("_cost", "_bucket", "_upto", "_before")


def balanced(df: DataFrame, cost: Column, bound: int, buckets: int = 1024) -> DataFrame:
    """``df`` in partitions that cost no more than ``bound``, unless a single row does."""
    # Numbers are written before they are used, so that a repeated task deals as the first one did.
    numbered = settled(placed(df, cost, bound, buckets, "_partition"))
    most = numbered.agg(F.max("_partition")).first()[0]
    return numbered.repartitionById(int(most or 0) + 1, F.col("_partition").cast("int")).drop("_partition")
