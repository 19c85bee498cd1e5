"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. One pass over the texts (Arrow batches) gives each document its set's size, a 128-bit digest of the set and 32
   band keys.  Documents with equal sets form a class; its smallest id stands for it.
2. In each bucket (equal band key) every class is paired with the bucket's smallest id only, so candidates grow in
   proportion to the documents, whatever the bucket's size.  Each pair is confirmed on the full sets.
3. Members of buckets that still lie in several components are gathered in clusters (linked by such buckets, so that
   a document appears once and not once per band), and clusters are dealt out in pairs of blocks of ``BLOCK`` members;
   each task confirms, on full sets, pairs from different components that share a band, skips pairs that it has joined
   already, and returns the edges that joined something: no bucket is capped, no pair list made.
4. Components of all confirmed links.

At a similarity of 0.75, 32 bands of 4 coordinates miss a pair with probability 5e-6.

Defined results: null, empty or blank texts have an empty set and link with nothing; rows with a null id link with
nothing and have a null component; repeated rows of an id share its component; ties go to the smallest id; texts are
read whole, whatever their length; empty tables give empty results; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlake.llm.common import components, drop, save

PERCENT = 75
BLOCK = 512
_DIGEST = "id long, n_shingles long, set_a long, set_b long, bands array<long>"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from outlake.llm.shingles import band_keys, set_digest, shingle_sets, signature

    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        size, first, second, bands = [], [], [], []
        for s in shingle_sets(texts):
            a, b = set_digest(s) if len(s) else (None, None)
            size.append(len(s))
            first.append(a)
            second.append(b)
            bands.append(band_keys(signature(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["id", "n_shingles", "set_a", "set_b", "bands"],
        )


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from outlake.llm.shingles import linked, shingle_sets

        for batch in batches:
            left = list(shingle_sets(batch.column("text_a").cast(pa.binary()).to_pylist()))
            right = list(shingle_sets(batch.column("text_b").cast(pa.binary()).to_pylist()))
            keep = [linked(x, y, percent) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirm_blocks(percent: int):
    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        from outlake.llm.shingles import linked, shingle_sets

        block = np.array(group.column("block").to_pylist())
        ids, comp = group.column("id").to_pylist(), group.column("component").to_pylist()
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        sets = list(shingle_sets(group.column("text").cast(pa.binary()).to_pylist()))
        size = np.array([len(s) for s in sets])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b, two = [], [], group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
        for i in range(len(ids) - 1):
            rest = slice(i + 1, None)
            shared = (bands[rest] == bands[i]).any(axis=1)
            near = 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
            if two:
                shared &= block[rest] != block[i]
            for j in np.flatnonzero(shared & near) + i + 1:
                x, y = find(comp[i]), find(comp[j])
                if x != y and linked(sets[i], sets[j], percent):
                    root[max(x, y)] = min(x, y)
                    a.append(comp[i])
                    b.append(comp[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``id, n_shingles, component, kept``."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = save(texts.mapInArrow(_digests, _DIGEST))
    known = signed.where("id is not null and n_shingles > 0")
    # written out, like the buckets' heads: joins of two exchanges let AQE split a large group of copies over tasks
    classes = save(known.groupBy("set_a", "set_b").agg(F.min("id").alias("rep")))
    members = save(known.select("id", "set_a", "set_b").distinct().join(classes, ["set_a", "set_b"]).select("id", "set_a", "set_b", "rep"))
    bands = known.select("id", "set_a", "set_b", "bands").dropDuplicates(["id", "set_a", "set_b"])
    shown = bands.join(members.where("id = rep"), ["id", "set_a", "set_b"])
    buckets = shown.select("id", F.explode("bands").alias("key"))
    heads = save(buckets.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1"))
    placed = save(buckets.join(heads, "key").select("key", "id", "head", "n"))
    unique_texts = texts.where("id is not null")

    pairs = placed.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    with_a = pairs.join(unique_texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(unique_texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    links = with_both.mapInArrow(_confirm(percent), "a long, b long")
    first = save(components(links))

    at = placed.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("n").alias("size")).where("size > 2 and lo < hi")
    together = at.join(mixed.select("key"), "key", "left_semi").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    clusters = save(components(together)).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        clusters.join(sizes, "cluster")
        .join(first.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", "id", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    )
    full = dealt.join(shown.select("id", "bands"), "id").join(unique_texts, "id")
    late = full.groupBy("cluster", "lo", "hi").applyInArrow(_confirm_blocks(percent), "a long, b long")
    second = save(components(late)).select(F.col("node").alias("component"), F.col("component").alias("last"))
    joined = first.join(second, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    alone = second.join(first, second["component"] == first["node"], "left_anti").select(F.col("component").alias("node"), F.col("last").alias("component"))
    final = joined.unionByName(alone)
    of_row = members.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("id", "set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    drop(placed)
    return (
        signed.select("id", "n_shingles", "set_a", "set_b")
        .join(of_row, ["id", "set_a", "set_b"], "left")
        .select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id."""
    gone = near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
