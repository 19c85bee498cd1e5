"""Duplicates and entity resolution over contacts and companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def duplicate_keys(rows: DataFrame, key: Column, across: str | None = None) -> DataFrame:
    """Keys that more than one row has, or that lie in more than one ``across``."""
    g = rows.where(key.isNotNull() & (key != "")).groupBy(key.alias("key"))
    if across is None:
        return g.agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.countDistinct(across).alias("n")).where("n > 1")


def keepers(rows: DataFrame, id_col: str, keys: list[Column], best_first: list[Column]) -> DataFrame:
    """``id, keep_id`` for every row of a group of duplicates: the best one is kept, ties go to the smallest id.

    The keeper is a grouped minimum of a struct of sort keys, so a huge group is reduced before the shuffle and no
    window has to hold it.
    """
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    on = [f"__k{i}" for i in range(len(keys))]
    ranked = rows.select(id_col, *named, F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*best_first, F.col(id_col)])]).alias("__o"))
    good = ranked.where(" and ".join(f"{k} is not null" for k in on))
    best = good.groupBy(*on).agg(F.min_by(id_col, "__o").alias("keep_id"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return good.join(best, on).select(id_col, "keep_id")


def repoint(children: DataFrame, moved: DataFrame, id_col: str) -> DataFrame:
    """``children`` with the ids of dropped duplicates replaced by their keeper's."""
    m = moved.where(f"{id_col} <> keep_id").select(F.col(id_col).alias("__old"), "keep_id")
    out = children.join(m, F.col(id_col) == F.col("__old"), "left")
    return out.withColumn(id_col, F.coalesce("keep_id", id_col)).drop("__old", "keep_id")


def collapse(rows: DataFrame, moved: DataFrame, id_col: str) -> DataFrame:
    """``rows`` without the dropped duplicates."""
    return rows.join(moved.where(f"{id_col} <> keep_id").select(id_col), id_col, "left_anti")


def clear_on_losers(rows: DataFrame, moved: DataFrame, id_col: str, column: str) -> DataFrame:
    """People of different companies are never merged: all but the keeper lose the shared identifier."""
    losers = moved.where(f"{id_col} <> keep_id").select(F.col(id_col).alias("__loser"))
    out = rows.join(losers, F.col(id_col) == F.col("__loser"), "left")
    return out.withColumn(column, F.when(F.col("__loser").isNotNull(), "").otherwise(F.col(column))).drop("__loser")


def _apart(key: str, id_col: str) -> Column:
    """The key, or, for rows without one, something of their own, so that they don't meet in one task."""
    return F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col(id_col).cast("string")))


def unique_name_keys(companies: DataFrame, key: Column, fallback: Column) -> DataFrame:
    """Name keys made unique: the oldest company keeps the plain key, others get ``key:fallback``."""
    order = W.partitionBy(_apart("__key", "company_id")).orderBy("created_at", "company_id")
    at = companies.withColumn("__key", key).withColumn("__n", F.row_number().over(order))
    unique = F.when(F.col("__key").isNull(), F.lit(None)).when(F.col("__n") == 1, F.col("__key")).otherwise(F.concat_ws(":", "__key", fallback))
    return at.withColumn("name_key", unique).drop("__key", "__n")


def collapsed_contacts(contacts: DataFrame, email: Column, profile: Column, best: list[Column]) -> DataFrame:
    """``contact_id, keep_id`` for every contact: duplicates within a company by address, then, among those that stay, by
    profile; the keeper of the keeper counts."""
    key = lambda c: F.nullif(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(""))
    by_email = keepers(contacts, "contact_id", [F.col("company_id"), key(email)], best).where("contact_id <> keep_id")
    left = contacts.join(by_email.select("contact_id"), "contact_id", "left_anti")
    by_profile = keepers(left, "contact_id", [F.col("company_id"), key(profile)], best).where("contact_id <> keep_id")
    second = by_profile.select(F.col("contact_id").alias("k"), F.col("keep_id").alias("k2"))
    at = contacts.select("contact_id").join(by_email, "contact_id", "left").withColumn("k", F.coalesce("keep_id", "contact_id")).join(second, "k", "left")
    return at.select("contact_id", F.coalesce("k2", "k").alias("keep_id"))


def merged_companies(companies: DataFrame, name_key: Column) -> DataFrame:
    """``company_id, keep_id, name_key`` for every company: one of a domain stays, the oldest; of those that stay, one of a
    name key has the plain key, others get a suffix of their domain's stem or id."""
    by_domain = keepers(companies, "company_id", [F.nullif(F.lower("domain"), F.lit(""))], [F.col("created_at")]).where("company_id <> keep_id")
    left = companies.join(by_domain.select("company_id"), "company_id", "left_anti").withColumn("k", name_key)
    n = F.row_number().over(W.partitionBy(_apart("k", "company_id")).orderBy("created_at", "company_id"))
    suffix = F.coalesce(F.substring_index(F.nullif(F.col("domain"), F.lit("")), ".", 1), F.col("company_id").cast("string"))
    keyed = left.select("company_id", F.when(F.col("k").isNull() | (n == 1), F.col("k")).otherwise(F.concat("k", F.lit(":"), suffix)).alias("name_key"))
    at = companies.select("company_id").join(by_domain, "company_id", "left").join(keyed, "company_id", "left")
    return at.select("company_id", F.coalesce("keep_id", "company_id").alias("keep_id"), "name_key")
