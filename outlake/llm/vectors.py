"""Vectors that can be computed with, and exact or floating sums of arrays over all tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums are added up in so many groups first, so that no task reads one row of each input partition.
GROUPS = 64
LOW = (1 << 32) - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str, *more: str) -> tuple[DataFrame, int, int]:
    """Rows ``id, v`` (doubles) and ``more`` columns with a vector of the commonest length (the longest of those that
    are equally common) without null or non-finite components; that length, and how many rows there are."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *[F.col(c).alias(f"more_{c}") for c in more])
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    found = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    size, n = (found.d, found.n) if found else (0, 0)
    return rows.where(F.size("v") == size), size, n


def matrix(batch: pa.RecordBatch, size: int):
    """The batch's vectors as rows of doubles."""
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def whole(x, factor: int, offset: int = 0):
    """floor(factor * x) + offset: int64, or Python integers where they are large.  Floors beyond a long are its limits."""
    import numpy as np

    with np.errstate(over="ignore"):
        down = np.floor(x * factor)
    if not down.size or np.abs(down).max() < 2**61:
        return down.astype(np.int64) + offset
    least, most = -(2**63), 2**63 - 1
    exact = [most if v >= 2.0**63 else least if v < -(2.0**63) else int(v) for v in down.ravel().tolist()]
    return np.array([v + offset for v in exact], object).reshape(down.shape)


def column_sums(x):
    """Exact sums of the columns, as Python integers."""
    import numpy as np

    if x.dtype != object and len(x) * (int(np.abs(x).max()) if x.size else 0) >= 2**62:
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=0)]


def halves(values: list[int]) -> list[int]:
    """Each integer as its upper part and its lower 32 bits: such longs can be added up over many tasks."""
    return [v >> 32 for v in values] + [v & LOW for v in values]


def joined(values: list[int]) -> list[int]:
    k = len(values) // 2
    return [(high << 32) + low for high, low in zip(values[:k], values[k:], strict=True)]


def array_sums(partial: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, sums``: the arrays ``sums`` of equal keys added place by place; ``part`` numbers the task they come from."""
    kinds = dict(partial.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        import numpy as np

        column = group.column("sums").combine_chunks()
        rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        total = pa.array([np.add.reduce(rows, axis=0)], column.type)
        return pa.table([group.column(c).slice(0, 1) for c in [*keys, "part"]] + [total], names=[*keys, "part", "sums"])

    some = partial.withColumn("part", F.col("part") % GROUPS).groupBy(*keys, "part").applyInArrow(add, schema)
    return some.groupBy(*keys).applyInArrow(add, schema).select(*keys, "sums")
