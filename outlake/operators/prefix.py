"""Running sums in an order, for keys of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outlake.sources.store import written


def same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    """Equal keys, nulls together; ``right`` has them under ``prefix``."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys))


def running(rows: DataFrame, keys: list[str], order: list[str], **amounts: Column) -> DataFrame:
    """``rows`` with the sum of each amount (a long, null counts as 0) over the earlier rows of the same keys.

    Two passes, so that a key with a third of all rows isn't one task: rows are dealt out by ranges of keys and order,
    ranges are summed, and each row gets what the earlier ranges of its key hold plus what comes before it in its own.
    ``order`` must tell the rows of a key apart.
    """
    marked = rows.withColumns({f"__{n}": F.coalesce(c.cast("long"), F.lit(0).cast("long")) for n, c in amounts.items()})
    dealt = written(marked.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    per_range = dealt.groupBy(*keys, "__range").agg(*[F.sum(f"__{n}").alias(n) for n in amounts])
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(*[F.col(k).alias(f"__of_{k}") for k in [*keys, "__range"]], *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__from_{n}") for n in amounts])
    own = W.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    at = dealt.join(offsets, same(dealt, offsets, [*keys, "__range"], "__of_"), "left")
    sums = [(F.coalesce(F.sum(f"__{n}").over(own), F.lit(0)) + F.col(f"__from_{n}")).alias(n) for n in amounts]
    return at.select(*rows.columns, *sums)


def following(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """``rows`` with ``next``: the value (null where a row has none) of the row itself or of the first later one of the
    same keys that has one.  Two passes over ranges, as in ``running``; ``order`` must tell the rows of a key apart."""
    held = F.when(value.isNotNull(), F.struct(*order, value.alias("value")))
    dealt = written(rows.withColumn("__held", held).repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    per_range = dealt.groupBy(*keys, "__range").agg(F.min("__held").alias("first"))
    # frames that grow from the end, as those that shrink are computed anew for every row
    after = W.partitionBy(*keys).orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)
    later = per_range.select(*[F.col(k).alias(f"__of_{k}") for k in [*keys, "__range"]], F.min("first").over(after).alias("__later"))
    own = W.partitionBy(*keys, "__range").orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    at = dealt.join(later, same(dealt, later, [*keys, "__range"], "__of_"), "left")
    return at.select(*rows.columns, F.coalesce(F.min("__held").over(own), "__later")["value"].alias("next"))
