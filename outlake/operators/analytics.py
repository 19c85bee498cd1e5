"""Reply-rate analytics over a fact table of emails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outlake.sources.store import written

#: Below this many sent emails a segment reports counts only.
MIN_SAMPLE = 10


def verified_reply() -> Column:
    return F.expr("has_response and response_verified_at is not null")


def unverified_reply() -> Column:
    return F.expr("has_response and response_verified_at is null")


def bigint_count_if(c: Column) -> Column:
    return F.count_if(c).cast("long")


def rate_of(replied: Column, sent: Column) -> Column:
    """Percent with one decimal, halves to even; null if nothing was sent."""
    return F.when(sent > 0, F.bround(replied / sent * 100, 1))


def dated(emails: DataFrame) -> DataFrame:
    """Dated sent emails: the facts of figures that ask nothing about contacts or companies, and so need no join."""
    return emails.where("status = 'sent' and sent_at is not null")


def sent_facts(emails: DataFrame, contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """Dated sent emails with the contact's and company's columns that segments use."""
    ct = contacts.select("contact_id", F.col("email_kind").alias("contact_email_kind"), "seniority_rank", F.col("company_id").alias("co_id"))
    co = companies.select(F.col("company_id").alias("co_id"), F.col("name").alias("company_name"))
    return dated(emails).join(ct, "contact_id", "left").join(co, "co_id", "left")


def with_seniority_band(rank: Column) -> Column:
    return F.when(rank <= 3, "executive").when(rank <= 8, "lead").when(rank <= 15, "individual").when(rank.isNotNull(), "other")


def follow_up_rung(step: Column, flagged: Column) -> Column:
    """The rung of an email; null for a flagged follow-up whose rung is unknown."""
    return F.when(step > 0, step).when(flagged, F.lit(None)).otherwise(0)


def segment(facts: DataFrame, key: Column, label: Column | None = None) -> DataFrame:
    """One row per key: sent, replied, unverified, enough_data, rate, dropped.

    Rows with a null or blank key are dropped, and their number stands on every row.
    """
    named = F.min(label if label is not None else key.cast("string"))
    grouped = facts.groupBy(F.nullif(key, F.lit("")) if label is None else key).agg(
        named.alias("label"),
        F.count("*").alias("sent"),
        bigint_count_if(verified_reply()).alias("replied"),
        bigint_count_if(unverified_reply()).alias("unverified"),
    )
    grouped = written(grouped.withColumnRenamed(grouped.columns[0], "key").withColumn("key", F.col("key").cast("string")))
    dropped = F.coalesce(grouped.where("key is null").agg(F.sum("sent")).scalar(), F.lit(0)).cast("long")
    enough = F.col("sent") >= MIN_SAMPLE
    return (
        grouped.withColumn("dropped", dropped)
        .where("key is not null")
        .withColumn("enough_data", enough)
        .withColumn("rate", F.when(enough, rate_of(F.col("replied"), F.col("sent"))))
        .select("key", "label", "sent", "replied", "unverified", "enough_data", "rate", "dropped")
    )


def all_segments(facts: DataFrame) -> DataFrame:
    """Six segmentations in one pass over the facts: ``dimension`` and the columns of ``segment``."""
    rung = follow_up_rung(F.col("follow_up_step"), F.col("is_follow_up"))
    keys = {
        "email_type": F.nullif(F.col("email_type"), F.lit("")),
        "email_kind": F.nullif(F.col("contact_email_kind"), F.lit("")),
        "seniority": with_seniority_band(F.col("seniority_rank")),
        "company": F.col("co_id").cast("string"),
        "written_by": F.when(F.col("used_template_fallback"), "template").otherwise("model"),
        "follow_up_step": rung.cast("string"),
    }
    pairs = [F.struct(F.lit(d).alias("dimension"), k.alias("key"), (F.coalesce("company_name", k) if d == "company" else k).alias("label")) for d, k in keys.items()]
    long = facts.select(F.explode(F.array(*pairs)).alias("x"), "has_response", "response_verified_at").select("x.*", "has_response", "response_verified_at")
    g = long.groupBy("dimension", "key").agg(
        F.min("label").alias("label"), F.count("*").alias("sent"), bigint_count_if(verified_reply()).alias("replied"), bigint_count_if(unverified_reply()).alias("unverified")
    )
    g = written(g)
    dropped = g.where("key is null").select("dimension", F.col("sent").alias("dropped"))
    enough = F.col("sent") >= MIN_SAMPLE
    return (
        g.where("key is not null").join(dropped, "dimension", "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)).cast("long"))
        .withColumn("enough_data", enough).withColumn("rate", F.when(enough, rate_of(F.col("replied"), F.col("sent"))))
    )


def totals(facts: DataFrame) -> DataFrame:
    t = facts.agg(F.count("*").alias("sent"), bigint_count_if(verified_reply()).alias("replied"), bigint_count_if(unverified_reply()).alias("unverified"))
    enough = F.col("sent") >= MIN_SAMPLE
    return t.withColumn("enough_data", enough).withColumn("rate", F.when(enough, rate_of(F.col("replied"), F.col("sent"))))


def hours_to_reply(facts: DataFrame, bucket_hours: int = 24) -> DataFrame:
    """Distribution of the hours to a verified reply by nearest rank (half up), and how many rows it leaves out.

    Hours are counted by value and by day.  The only ordering without a key is that of the days; ranks are then told apart
    inside the days that hold them, each of which has 2400 values at most.
    """
    gap = F.round((F.unix_micros(F.col("response_at").cast("timestamp")) - F.unix_micros(F.col("sent_at").cast("timestamp"))) / 3.6e9, 2)
    counted = written(facts.where(verified_reply()).select(gap.alias("h")).groupBy("h").agg(F.count("*").alias("n")).withColumn("day", F.floor(F.col("h") / bucket_hours)))
    good = counted.where("h >= 0")
    days = good.groupBy("day").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow))
    days = days.withColumn("upto", upto).withColumn("total", F.sum("n").over(W.partitionBy()))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("f")) for k, f in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))]))
    rank = F.floor(F.col("q.f") * (F.col("total") - 1) + 0.5)
    held = days.select("*", asked.alias("q")).withColumn("rank", rank).where("upto > rank and upto - n <= rank").select("day", "q.k", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    run = F.sum("n").over(W.partitionBy("k").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = good.join(held, "day").withColumn("run", run).where("run > rank").groupBy().pivot("k", ["median", "p25", "p75"]).agg(F.min("h"))
    every = counted.agg(
        F.coalesce(F.sum(F.when(F.col("h") >= 0, F.col("n"))), F.lit(0)).alias("count"), F.coalesce(F.sum("n"), F.lit(0)).alias("every"),
        F.min(F.when(F.col("h") >= 0, F.col("h"))).alias("fastest"), F.max(F.when(F.col("h") >= 0, F.col("h"))).alias("slowest"),
    )
    return every.join(F.broadcast(found)).select("count", "median", "p25", "p75", "fastest", "slowest", (F.col("every") - F.col("count")).alias("excluded"))


def best_and_worst(segments: DataFrame) -> DataFrame:
    """Best and worst segment with enough data; nulls unless there are two.  Ties keep the order by sent, then label."""
    order = F.struct(-F.col("rate"), -F.col("sent"), "label", "key")
    t = segments.where("enough_data").agg(
        F.count("*").alias("n"), F.min_by("key", order).alias("best"), F.max_by("key", order).alias("worst"), F.max("rate").alias("hi"), F.min("rate").alias("lo")
    )
    two = F.col("n") >= 2
    return t.select(F.when(two, F.col("best")).alias("best"), F.when(two, F.col("worst")).alias("worst"), F.when(two, F.bround(F.col("hi") - F.col("lo"), 1)).alias("spread"))


def dashboard(emails: DataFrame, contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """Counters over the whole database; the rate is 0 when nothing was sent."""
    e = emails.agg(
        bigint_count_if(F.expr("status in ('draft', 'approved')")).alias("drafts"),
        bigint_count_if(F.expr("status = 'sent'")).alias("sent"),
        bigint_count_if(F.expr("status = 'sent'") & verified_reply()).alias("replied"),
        bigint_count_if(F.expr("status = 'sent'") & unverified_reply()).alias("unverified"),
    )
    one = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    return e.join(one(contacts, "contacts")).join(one(companies, "companies")).withColumn("reply_rate", F.coalesce(rate_of(F.col("replied"), F.col("sent")), F.lit(0.0)))


def timeline(emails: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Sent emails and verified replies for each of the last ``days`` days, zero-filled."""
    spark = emails.sparkSession
    calendar = spark.range(days).select(F.expr(f"date_sub(to_date({as_of}), int(id))").alias("day"))
    first = F.expr(f"date_sub(to_date({as_of}), {days - 1})")
    sent = emails.where("sent_at is not null and status = 'sent'").where(F.to_date("sent_at") >= first).groupBy(F.to_date("sent_at").alias("day")).agg(F.count("*").alias("sent"))
    back = emails.where(verified_reply()).where(F.to_date("response_at") >= first).groupBy(F.to_date("response_at").alias("day")).agg(F.count("*").alias("replies"))
    out = calendar.join(sent, "day", "left").join(back, "day", "left")
    return out.select("day", F.coalesce("sent", F.lit(0)).alias("sent"), F.coalesce("replies", F.lit(0)).alias("replies"))


def by_type(emails: DataFrame) -> DataFrame:
    sent = F.expr("status = 'sent'")
    return emails.where("status <> 'trashed'").groupBy("email_type").agg(
        F.count("*").alias("total"),
        bigint_count_if(sent).alias("sent"),
        bigint_count_if(sent & verified_reply()).alias("replied"),
        bigint_count_if(sent & unverified_reply()).alias("unverified"),
    )


def batch_stamped(emails: DataFrame, least: int = 3) -> DataFrame:
    """Minutes that hold ``least`` reply stamps or more: replies that a batch stamped rather than a person sent."""
    minute = F.date_trunc("minute", F.col("response_at").cast("timestamp_ntz")).cast("timestamp_ntz")
    return emails.where("response_at is not null").groupBy(minute.alias("minute")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def batch_stamped_rows(emails: DataFrame, least: int = 3) -> DataFrame:
    """The emails whose reply was stamped in such a minute."""
    minute = F.date_trunc("minute", F.col("response_at").cast("timestamp_ntz")).cast("timestamp_ntz")
    return emails.withColumn("minute", minute).join(batch_stamped(emails, least), "minute", "left_semi").select("email_id", "response_at")
