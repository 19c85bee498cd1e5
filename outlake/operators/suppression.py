"""Do-not-contact lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outlake.functions.identity import canonical_mailbox, domain_chain, email_domain


def first_entries(entries: DataFrame) -> DataFrame:
    """Inserts are idempotent: the first entry of a kind and value wins."""
    order = W.partitionBy("kind", "value").orderBy("created_at", "suppression_id")
    return entries.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def candidates(addresses: DataFrame, entries: DataFrame, id_col: str, email_col: str) -> DataFrame:
    """All entries that block an address: equi-joins on the mailbox and on every parent domain."""
    a = addresses.where(F.coalesce(F.trim(F.col(email_col)), F.lit("")) != "").select(F.col(id_col), F.col(email_col).alias("__email"))
    e = entries.select("suppression_id", "kind", "value", "created_at")
    by_box = a.join(e.where("kind = 'address'").withColumn("__key", canonical_mailbox(F.col("value"))), canonical_mailbox(F.col("__email")) == F.col("__key")).withColumn("__depth", F.lit(-1))
    chain = a.select(id_col, F.posexplode(domain_chain(email_domain(F.col("__email")))).alias("__depth", "__domain"))
    by_domain = chain.join(e.where("kind = 'domain'"), F.col("__domain") == F.lower("value"))
    cols = [id_col, "suppression_id", "kind", "value", "created_at", "__depth"]
    return by_box.select(cols).unionByName(by_domain.select(cols))


def match(addresses: DataFrame, entries: DataFrame, id_col: str, email_col: str) -> DataFrame:
    """The entry that blocks each blocked address: addresses before domains, the most specific domain first, among
    equals the first of the list (newest, then by value)."""
    newest = (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("o")
    # of entries with the same key the first of the list is all that can block: an address meets each key once
    key = F.when(F.col("kind") == "address", canonical_mailbox(F.col("value"))).otherwise(F.lower("value"))
    firsts = entries.groupBy("kind", key.alias("__key")).agg(F.min(F.struct(newest, "value", "suppression_id", "created_at")).alias("x")).select("kind", "x.*")
    # the smallest of a struct needs no sort of an address's entries
    order = F.struct("__depth", newest, "value", "suppression_id", "kind")
    best = candidates(addresses, firsts, id_col, email_col).groupBy(id_col).agg(F.min(order).alias("b"))
    return best.select(id_col, "b.suppression_id", "b.kind", "b.value")


def coverage(addresses: DataFrame, entries: DataFrame, id_col: str, email_col: str) -> DataFrame:
    """How many addresses each entry matches."""
    hits = candidates(addresses, entries, id_col, email_col).select("suppression_id", id_col).distinct().groupBy("suppression_id").agg(F.count("*").alias("matched"))
    return entries.select("suppression_id", "kind", "value").join(hits, "suppression_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
