"""Window-shaped operators over emails, messages and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_in_batch(rows: DataFrame, batch: list[str], position: str) -> DataFrame:
    """``place`` 1 is the row of each batch, recipient and kind that may go; later ones are duplicates."""
    order = W.partitionBy(*batch, F.lower("recipient_email"), "is_follow_up").orderBy(position)
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def daily_cap(rows: DataFrame, actor: str, at: str, position: str, cap: int) -> DataFrame:
    """``over_cap``: the day's cap was reached before this row; so it is for every later row of the day."""
    order = W.partitionBy(actor, F.to_date(at)).orderBy(at, position)
    return rows.withColumn("over_cap", F.row_number().over(order) > cap)


def burst(events: DataFrame, actor: str, at: str, seconds: int = 60) -> DataFrame:
    """Events of the actor in the last ``seconds`` (strictly younger), and the wait until the oldest of them is out."""
    # a range frame over microseconds leaves out what is exactly ``seconds`` old
    us = F.unix_micros(F.col(at).cast("timestamp"))
    frame = W.partitionBy(actor).orderBy("__us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    out = events.withColumn("__us", us).withColumn("in_window", F.count("*").over(frame)).withColumn("__first", F.min("__us").over(frame))
    wait = F.round(seconds - (F.col("__us") - F.col("__first")) / 1e6 + 0.05, 2)
    return out.withColumn("retry_after", wait).drop("__us", "__first")


def newest_messages(messages: DataFrame, most: int = 50) -> DataFrame:
    """The newest messages of each thread in order, and how many older ones are left out."""
    place = F.row_number().over(W.partitionBy("thread_id").orderBy(F.desc("message_no")))
    total = messages.groupBy("thread_id").agg(F.greatest(F.lit(0).cast("long"), F.count("*") - most).alias("older_omitted"))
    kept = messages.withColumn("__n", place).where(F.col("__n") <= most).drop("__n")
    return kept.join(total, "thread_id").select("thread_id", "message_no", "kind", "older_omitted")


def thread_counters(messages: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k).cast("long")
    last = lambda k: F.max(F.when(F.col("kind") == k, F.col("message_no")))
    return messages.groupBy("thread_id").agg(n("REPLY").alias("replies"), n("OWN").alias("own"), n("AUTO").alias("auto"), last("REPLY").alias("last_reply"), last("AUTO").alias("last_auto"))


def oldest_due_batch(rows: DataFrame, batch: str, at: str, as_of: str) -> DataFrame:
    """All due rows that share the batch of the earliest due one: a one-row aggregate joined back, no global sort."""
    due = rows.where(F.col(at) <= F.expr(as_of))
    first = due.agg(F.min_by(batch, F.struct(at, "email_id")).alias(batch))
    return due.join(first, batch, "left_semi")


def daily_usage(events: DataFrame, names: list[str], limit: int) -> DataFrame:
    """Counted events per actor and day and what is left of the limit; the log is counted, so deletions give no refund."""
    used = F.count_if(F.col("event").isin(names)).cast("long")
    g = events.groupBy("entity_id", F.to_date("created_at").alias("day")).agg(used.alias("used"))
    return g.withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col("used")))


def previous_touch(emails: DataFrame) -> DataFrame:
    """The latest message known for each contact; undated ones count as oldest."""
    known = F.struct(F.coalesce("sent_at", F.expr("timestamp_ntz '1970-01-01 00:00:00'")), "email_id")
    return emails.where("status = 'sent' and contact_id is not null").groupBy("contact_id").agg(F.max_by("email_id", known).alias("email_id"))
