"""Campaign reports (A7-A10): counted from the campaign stamped on the rows, never by joining through contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlake.operators.analytics import MIN_SAMPLE, rate_of, unverified_reply, verified_reply
from outlake.operators.pipeline import counts_as_sent

_COUNTS = ("companies", "contacts", "sent", "drafts", "replied", "unverified", "bounced")


def _counts(emails: DataFrame):
    n = lambda c: F.count_if(c).cast("long")
    return emails.groupBy("campaign_id").agg(
        n(counts_as_sent()).alias("sent"),
        n(F.expr("status in ('draft', 'approved')") & ~counts_as_sent()).alias("drafts"),
        n(verified_reply()).alias("replied"),
        n(unverified_reply()).alias("unverified"),
        n(F.col("bounced_at").isNotNull()).alias("bounced"),
        F.max("sent_at").alias("last_sent_at"),
    )


def _per_campaign(emails: DataFrame, contacts: DataFrame, companies: DataFrame) -> list[DataFrame]:
    count = lambda df, name: df.groupBy("campaign_id").agg(F.count("*").alias(name))
    return [_counts(emails), count(contacts, "contacts"), count(companies, "companies")]


def _scored(df: DataFrame) -> DataFrame:
    df = df.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in _COUNTS})
    enough = F.col("sent") >= MIN_SAMPLE
    return df.withColumn("enough_data", enough).withColumn("rate", F.when(enough, rate_of(F.col("replied"), F.col("sent"))))


def rollup(campaigns: DataFrame, emails: DataFrame, contacts: DataFrame, companies: DataFrame) -> DataFrame:
    out = campaigns
    for part in _per_campaign(emails, contacts, companies):
        out = out.join(part, "campaign_id", "left")
    return _scored(out)


def unassigned(emails: DataFrame, contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """The same figures for rows without a campaign; they are never part of the totals."""
    null = [df.where("campaign_id is null").withColumn("campaign_id", F.lit(0)) for df in (emails, contacts, companies)]
    first, *rest = _per_campaign(*null)
    out = emails.sparkSession.range(1).select(F.lit(0).alias("campaign_id")).join(first, "campaign_id", "left")
    for part in rest:
        out = out.join(part, "campaign_id", "left")
    return _scored(out).drop("campaign_id")
