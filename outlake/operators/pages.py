"""Pages of a global order without offsets (O4, S1): ranks are stored once, a page is one pruned read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlake.operators.prefix import running
from outlake.sources.store import scratch

PAGES_PER_FOLDER = 400


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``, from 1, in a global order that tells rows apart: ranges and their sizes, no global sort."""
    keys = [f"__k{i}" for i in range(len(order))]
    at = rows.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    return running(at, [], keys, place=F.lit(1)).drop(*keys).withColumn("place", F.col("place") + 1)


@dataclass
class Index:
    """A stored order: the table, how many rows, and how many a page has."""

    table: DataFrame
    total: int
    size: int

    @property
    def pages(self) -> int:
        return max(1, -(-self.total // self.size))

    def page(self, number: int) -> DataFrame:
        """A page, from 1; numbers beyond either end give the first or last one.  One folder of the table is read."""
        number = min(max(1, number), self.pages)
        at = (F.col("page") == number) & (F.col("folder") == (number - 1) // PAGES_PER_FOLDER)
        return self.table.where(at).drop("page", "folder").orderBy("place")


def stored(rows: DataFrame, order: list[Column], size: int) -> Index:
    """Write ``rows`` in their order, dealt into folders of pages, in the shared folder."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    page = F.ceil(F.col("place") / size).cast("int")
    at = ranked(rows, order).withColumn("page", page).withColumn("folder", F.floor((F.col("page") - 1) / PAGES_PER_FOLDER).cast("int"))
    # files within a folder hold runs of pages, so that their statistics prune too
    at.repartitionByRange("folder", "page").sortWithinPartitions("folder", "place").write.partitionBy("folder").parquet(path)
    schema = at.drop("folder").schema.add("folder", "integer")
    table = spark.read.schema(schema).parquet(path)
    return Index(table, table.count(), size)
