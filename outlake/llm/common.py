"""Shared helpers: reading tables, scratch tables in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word character class: everything outside \x20 and \x09-\x0D.
BLANKS = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.  Where it is unset, a temporary folder of this
    machine serves a local session; on a cluster the executors couldn't see it, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def save(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.  It survives lost executors; the
    files go when the session ends, or with ``drop``.  The shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(*saved: DataFrame) -> None:
    """Delete tables made by ``save`` that no later step reads."""
    for df in saved:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long): ``node, component``, the component being its smallest node.

    Alternating large-star and small-star rounds; each is two grouped minima and joins, so no node's neighbours are
    ever gathered in one task and nothing goes to the driver but two counts.  Nodes without an edge to another node
    don't appear; null ends are ignored.
    """
    at = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    at, seen, old = save(at), None, []
    while True:
        # the minima are written out: joins of two exchanges let AQE split a hub's neighbours over tasks
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = save(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = save(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        drop(least, large, lower, *old)
        old = [at]
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
