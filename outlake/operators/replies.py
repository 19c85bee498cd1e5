"""Replies and bounces of threads, and what a check of them does to the emails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thread_verdicts(classed: DataFrame) -> DataFrame:
    """Per thread the counts and the latest reply and bounce by time; what we sent ourselves doesn't count, and a reply
    outranks a bounce.  ``classed`` has thread_id, internal_ms, sent_label and class."""
    theirs = ~F.col("sent_label")
    n = lambda c: F.count_if(theirs & (F.col("class") == c)).cast("long")
    last = lambda c: F.max(F.when(theirs & (F.col("class") == c), F.col("internal_ms")))
    out = classed.groupBy("thread_id").agg(
        F.count("*").alias("messages"), n("reply").alias("reply_count"), n("bounce").alias("bounce_count"), last("reply").alias("replied_ms"), last("bounce").alias("bounced_ms")
    )
    verdict = F.when(F.col("reply_count") > 0, "reply").when(F.col("bounce_count") > 0, "bounce").otherwise("none")
    return out.withColumn("verdict", verdict)


def thread_counters(classed: DataFrame, emails: DataFrame, shown: int = 50) -> DataFrame:
    """Counters of each email's thread, how many older messages a view of ``shown`` leaves out, and what the thread has
    that the email doesn't record.  ``emails`` has email_id, thread_id, has_response and bounced_at."""
    t = thread_verdicts(classed)
    at = emails.join(t, "thread_id")
    return at.select(
        "email_id", "reply_count", "bounce_count", F.greatest(F.lit(0), F.col("messages") - shown).alias("older_omitted"),
        ((F.col("reply_count") > 0) & ~F.col("has_response")).alias("unrecorded_reply"), ((F.col("bounce_count") > 0) & F.col("bounced_at").isNull()).alias("unrecorded_bounce"),
    )


def outcome() -> Column:
    """What a verdict (reply, bounce, none; null: the check failed) does to an email's reply state."""
    return F.expr(
        "case when verdict is null then 'failed' when verdict = 'reply' and not has_response then 'new' when verdict = 'reply' and response_verified_at is null then 'confirmed' "
        "when verdict = 'reply' then 'kept' when has_response then 'cleared' else 'none' end"
    )


def checked(emails: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Emails of a check with their outcome, and their reply state after it.  ``verdicts`` has email_id, verdict and
    bounced (whether the thread holds a bounce)."""
    at = emails.join(verdicts, "email_id", "left").withColumn("outcome", outcome())
    state = at.withColumn("bounced_now", F.coalesce(F.col("bounced") & F.col("bounced_at").isNull(), F.lit(False)))
    after = F.expr("case outcome when 'new' then true when 'cleared' then false else has_response end")
    verified = F.expr("case when outcome in ('new', 'confirmed', 'kept') then true when outcome = 'cleared' then false else response_verified_at is not null end")
    return state.withColumn("has_response_after", after).withColumn("verified_after", verified)


def check_counters(checked_rows: DataFrame) -> DataFrame:
    """One row: how many were checked, each outcome's count, and unverified reply flags that remain."""
    n = lambda c: F.count_if(F.col("outcome") == c).cast("long")
    return checked_rows.agg(
        F.count("*").alias("checked"), n("new").alias("new_replies"), n("confirmed").alias("confirmed"), n("cleared").alias("cleared"), n("failed").alias("failed_checks"),
        F.count_if("bounced_now").cast("long").alias("bounced"), F.count_if(F.col("has_response_after") & ~F.col("verified_after")).cast("long").alias("unverified_remaining"),
    )


def folded_states(verdicts: DataFrame) -> DataFrame:
    """The reply state of each email after all its verdicts in order, from no reply: unknown verdicts change nothing, a
    bounce is recorded once, the first one.  ``verdicts`` has email_id, verdict_no, verdict.

    The state is the last verdict that says something about a reply; so no row-by-row fold is needed.
    """
    order = F.struct("checked_at", "verdict_no")
    said = F.col("verdict").isin("reply", "none")
    g = verdicts.groupBy("email_id").agg(
        F.max_by("verdict", F.when(said, order)).alias("last"),
        F.count_if(said & (F.col("verdict") == "reply")).cast("long").alias("reply_checks"),
        F.min(F.when(F.col("verdict") == "bounce", F.col("checked_at"))).alias("bounced_at"),
    )
    last = F.coalesce(F.col("last") == "reply", F.lit(False))
    return g.select("email_id", last.alias("has_response"), "bounced_at")
