"""Sources and sinks: scratch folders that all executors share, event streams, CSV export and import."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, removed when the session's process ends.  Where it is unset, a temporary folder of this machine serves a
    local session; on a cluster the executors couldn't see it, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/streams/{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{folder.toString()}/t"


def written(df: DataFrame) -> DataFrame:
    """Lineage cut by a table in the shared folder: what several steps read is computed once and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table dealt out over all cores if its files make fewer tasks: for work that is heavy by row, as a table that
    is small on disk may have a million."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 16) -> DataFrame:
    """The event table, a single file or a folder of part files, as a stream of files."""
    at = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", files_per_trigger)
    # the filter knows file names only: it picks a single file out of its folder and would leave no part file
    raw = stream.parquet(at) if _is_folder(spark, at) else stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("event"))


def appended(parts: list[DataFrame]) -> DataFrame:
    """An append-only log: each part is appended to the same table, which is read back."""
    spark, path = parts[0].sparkSession, f"{scratch(parts[0].sparkSession)}/log"
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def flat_messages(threads: DataFrame) -> DataFrame:
    """Messages of provider threads (a JSON text in ``thread``), one row each, in order."""
    shape = "id long, messages array<struct<turn: long, role: string, text: string>>"
    at = threads.select(F.from_json("thread", shape).alias("t"))
    return at.select(F.col("t.id").alias("thread_id"), F.posexplode("t.messages").alias("place", "m")).select("thread_id", "place", "m.role", "m.text")


# Names that are titles of pages.
PAGE_TITLES = ("about", "about us", "team", "our team", "company", "contact", "home", "leadership", "people")
MOST_DEPTH = 6


def people_in_json(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """How many objects of a JSON text look like people (a name that is no page title, and an address or a profile), down
    to ``MOST_DEPTH``; junk has none."""
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    name = F.lower(F.trim(F.coalesce(*[F.nullif(text(k), F.lit("")) for k in ("name", "full_name", "fullName")])))
    reach = text("email").contains("@") | F.lower(F.coalesce(F.nullif(text("linkedin"), F.lit("")), text("linkedin_url"))).contains("linkedin.com")
    person = F.coalesce((name != "") & ~name.isin(*PAGE_TITLES), F.lit(False)) & F.coalesce(reach, F.lit(False))
    level = rows.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(json_col)).alias("v"))
    found = []
    for depth in range(MOST_DEPTH + 1):
        found.append(level.where(person).select("id"))
        if depth < MOST_DEPTH:
            level = level.sparkSession.sql("select t.id, e.value as v from {t} t, lateral variant_explode(t.v) e where schema_of_variant(e.value) like 'ARRAY%' or schema_of_variant(e.value) like 'OBJECT%'", t=level)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    counts = every.groupBy("id").agg(F.count("*").alias("n"))
    return rows.select(F.col(id_col).alias("id")).join(counts, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n"))


def safe_cell(text: Column) -> Column:
    """Text that a spreadsheet doesn't take for a formula."""
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)


def export_csv(rows: DataFrame, path: str) -> None:
    kinds = dict(rows.dtypes)
    rows.select(*[safe_cell(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in rows.columns]).write.option("header", True).csv(path)


# Fixed value: what the other dialect says of everybody in it.
CONNECTION = "Direct LinkedIn connection"


def read_contacts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Contacts from a CSV file in either dialect (S2): our own columns, or a connections export."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    have = set(raw.columns)
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) if c in have else F.lit("")
    if {"first name", "last name", "url", "company", "position"} <= have:
        name = F.trim(F.concat_ws(" ", text("first name"), text("last name")))
        cols = [name.alias("name"), text("company").alias("company"), text("email address").alias("email"), text("url").alias("linkedin_url"), text("position").alias("role")]
        return raw.select(*cols, F.lit(CONNECTION).alias("affinity"), F.lit("connections").alias("source"))
    if {"name", "company"} <= have and have & {"email", "linkedin_url"}:
        return raw.select(*[text(c).alias(c) for c in ("name", "company", "email", "linkedin_url", "role", "affinity")], F.lit("csv").alias("source"))
    raise ValueError(f"columns of neither dialect: {sorted(have)}")
