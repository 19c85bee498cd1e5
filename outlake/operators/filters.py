"""Searches, named views and text predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outlake.operators.analytics import follow_up_rung, verified_reply, with_seniority_band


def search(rows: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows with the term in one of the columns, whatever its case; ``%`` and ``_`` stay wildcards."""
    return rows.where(reduce(Column.__or__, [F.coalesce(F.ilike(c, F.lit(f"%{term}%")), F.lit(False)) for c in columns]))


def bands(emails: DataFrame, contacts: DataFrame) -> DataFrame:
    ranked = emails.join(contacts.select("contact_id", "seniority_rank"), "contact_id", "left")
    rung = follow_up_rung(F.col("follow_up_step"), F.col("is_follow_up"))
    return ranked.select("email_id", with_seniority_band(F.col("seniority_rank")).alias("band"), rung.alias("rung"))


def contact_view_counts(contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """How many contacts each named view shows, in one pass."""
    mail = emails.groupBy("contact_id").agg(F.count("*").alias("n"), F.count_if(verified_reply()).alias("v"))
    rows = contacts.join(mail, "contact_id", "left")
    views = {
        "active": "status <> 'archived'", "archived": "status = 'archived'", "personal_email": "email_kind = 'personal' or person_verified", "replied": "coalesce(v, 0) > 0",
        "senior": "coalesce(seniority_rank, 99) <= 5", "uncontacted": "coalesce(n, 0) = 0", "verified": "person_verified",
    }
    shown = F.filter(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in views.items()]), lambda x: x.isNotNull())
    counted = rows.select(F.explode(shown).alias("view")).groupBy("view").agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(k,) for k in views], "view string")
    return every.join(counted, "view", "left").select("view", F.coalesce("n", F.lit(0)).alias("n"))


def summaries(docs: DataFrame, most: int = 3, chars: int = 400) -> DataFrame:
    """The first sentences of some length."""
    sentences = F.regexp_extract_all(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("[^.!?]+[.!?]*"), F.lit(0))
    long = F.filter(sentences, lambda x: F.length(F.trim(x)) > 40)
    return docs.select("doc_id", F.substring(F.array_join(F.slice(long, 1, most), ""), 1, chars).alias("summary"))


def sorted_places(rows: DataFrame, sorts: dict[str, list[str]], id_col: str, most: int) -> DataFrame:
    """The first ``most`` rows under each of several named sorts, with their place."""
    out = None
    for name, keys in sorts.items():
        top = rows.orderBy(*[F.expr(k) for k in keys], id_col).limit(most).select(*[F.expr(k).alias(f"k{i}") for i, k in enumerate(keys)], id_col)
        place = F.row_number().over(W.orderBy(*[f"k{i}" for i in range(len(keys))], id_col)).cast("long")  # over ``most`` rows
        part = top.select(F.lit(name).alias("sort"), id_col, place.alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


def page(rows: DataFrame, keys: list[str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) in an order; beyond the last page, the last one."""
    last = max(0, (rows.count() - 1) // size)
    return rows.orderBy(*[F.expr(k) for k in keys]).offset(min(number, last) * size).limit(size)
