"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors of a label are normalised in double precision and dealt out in tiles; each pair of tiles is one group.  There
the vectors, quantised to int8 with a scale of their own, are multiplied as blocks; with e the distance of a unit
vector from its quantised form, the true cosine is within e_a + e_b + e_a * e_b of the product.  Pairs certainly at
or above the threshold count, pairs certainly below it don't, and those between are computed again in double
precision.  A group returns, for each vector, how many partners it has, and a forest of its links; never pairs.

Exactly equal unit vectors need no special case: they fill a tile like any others and give one forest.
Tiles grow with the label (``TILE`` to ``MOST_TILE`` vectors), so that copies of a vector stay few.

Defined results: vectors that are null, empty, zero or have null or non-finite components, rows with a null label and
rows with a null id link with nothing; vectors of different lengths don't link; a repeated id counts as one vector for
each row, its rows share a component, and its number of links is that of all its rows; ties go to the smallest id; very
large and very small components are scaled first; vectors of any length are multiplied whole; labels are of any type;
empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlake.llm.common import components, save

THRESHOLD = 0.98
TILE, MOST_TILE, TILES = 1024, 16384, 16
STRIP = 1024


def scaled(full):
    """The vectors with their largest component between a half and one: powers of two change no digit of the cosine,
    and squares neither overflow nor vanish."""
    import numpy as np

    return np.ldexp(full, -np.frexp(np.abs(full).max(axis=1, keepdims=True))[1])


def quantise(unit):
    """int8 codes, their scales and the distance of each unit vector from its quantised form (rounded up)."""
    import numpy as np

    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return codes, scale, error


def _tiles(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        ids = group.column("row").to_numpy()
        tile = group.column("tile").to_numpy()
        left_id, right_id = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        column = group.column("v").combine_chunks()
        size = len(column.values) // len(ids) if len(ids) else 0
        full = scaled(column.values.to_numpy(zero_copy_only=False).reshape(len(ids), size).astype(np.float64))
        norm = np.sqrt((full * full).sum(axis=1))
        unit = full / norm[:, None]
        codes, scale, error = quantise(unit)
        wide = codes.astype(np.float32)  # products of codes are integers below 2 ** 24 up to 1040 components: exact
        if size > 1000:
            wide = codes.astype(np.float64)
        left, right = np.flatnonzero(tile == left_id), np.flatnonzero(tile == right_id)
        same = left_id == right_id
        n = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at in range(0, len(left), STRIP):
            a = left[at : at + STRIP]
            for to in range(at if same else 0, len(right), STRIP):
                b = right[to : to + STRIP]
                product = (wide[a] @ wide[b].T).astype(np.float64) * scale[a][:, None] * scale[b]
                slack = error[a][:, None] + error[b] + error[a][:, None] * error[b] + 1e-9
                link = product - slack >= threshold
                maybe = ~link & (product + slack >= threshold)
                if same:
                    above = a[:, None] < b
                    link &= above
                    maybe &= above
                i, j = np.nonzero(maybe)
                if len(i):
                    for k in range(0, len(i), 1 << 16):
                        x, y = a[i[k : k + (1 << 16)]], b[j[k : k + (1 << 16)]]
                        exact = (full[x] * full[y]).sum(axis=1) / (norm[x] * norm[y])
                        link[i[k : k + (1 << 16)], j[k : k + (1 << 16)]] = exact >= threshold
                n[a] += link.sum(axis=1)
                n[b] += link.sum(axis=0)
                for r in np.flatnonzero(link.any(axis=1)):
                    x, others = find(a[r]), b[link[r]]
                    for y in np.unique(root[others]):
                        y = find(y)
                        x, y = min(x, y), max(x, y)
                        root[y] = x
                    root[others] = x
        linked = np.flatnonzero(n)
        return pa.table({"row": pa.array(ids[linked], pa.int64()), "n": pa.array(n[linked], pa.int64()), "first": pa.array([int(ids[find(x)]) for x in linked], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: ``id, n_links, component, kept``."""
    # single-precision components are dealt out as they are, half as wide
    kind = vectors.schema[vector_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x).cast("double") < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    good = rows.where(usable).select("id", "v", F.struct("label", F.size("v").alias("size")).alias("part"))
    sizes = good.groupBy("part").agg(F.count("*").alias("n"))
    tile_rows = F.least(F.lit(MOST_TILE), F.greatest(F.lit(TILE), F.ceil(F.col("n") / TILES)))
    sizes = save(sizes.select("part", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles")))
    placed = good.join(sizes, "part").withColumn("tile", F.pmod(F.xxhash64("id", "v"), F.col("tiles")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "part", F.col("id").alias("row"), "v", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")
    )
    found = save(dealt.groupBy("part", "lo", "hi").applyInArrow(_tiles(threshold), "row long, n long, first long"))
    counts = found.groupBy("row").agg(F.sum("n").alias("n"))
    comps = save(components(found.select(F.col("row").alias("a"), F.col("first").alias("b"))))
    return (
        rows.select("id")
        .join(counts.withColumnRenamed("row", "id"), "id", "left")
        .join(comps.withColumnRenamed("node", "id"), "id", "left")
        .select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
    )
