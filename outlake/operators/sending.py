"""Batches of mails under a daily limit of each sender, with markers that wait for an outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlake.operators.prefix import running

#: Reasons that are found before the recipient's marker is asked, and those found before the daily limit is.
FIRST = ("not sendable", "already delivered")
UNSETTLED = ("reconciled", "attempt pending")


def send_batches(queue: DataFrame, sent_before: DataFrame, limit: int) -> DataFrame:
    """What becomes of each mail of a batch, in order: ``email_id, decision``.

    ``queue`` has sender, day, batch, position, email_id, recipient, is_follow_up, reason (the first rule of the row
    itself that refuses it, or null) and outcome (what sending gives: sent, unknown or refused); ``sent_before`` has
    sender, day and n, what went out on the day outside these batches.

    - A mail that goes out, or may have, marks its recipient for its kind (first contact or follow-up) and its batch;
      a refused one doesn't, so the next copy is tried.
    - Before a mail that would be tried, the day's count of the sender, earlier batches included, is compared with the
      limit; once it is reached, this row and all later ones of the batch are left, whatever else holds for them.

    Markers are a grouped minimum: rows before it were all refused, rows after it are duplicates.  The count is a
    prefix sum by ranges, and the first row over the limit a minimum again; so no batch, recipient or sender is one task.
    """
    kind = ["sender", "day", "batch", "recipient", "is_follow_up"]
    batch = ["sender", "day", "batch"]
    rows = queue.select(*batch, "position", "email_id", F.lower(F.trim(F.coalesce("recipient", F.lit("")))).alias("recipient"), F.coalesce("is_follow_up", F.lit(False)).alias("is_follow_up"), "reason", "outcome")
    rows = rows.withColumn("sender", F.coalesce("sender", F.lit(-1)))
    arms = rows.where("reason is null and outcome in ('sent', 'unknown') and recipient <> ''")
    marks = arms.groupBy(*kind).agg(F.min("position").alias("marked"))
    first = F.coalesce(F.col("reason").isin(*FIRST), F.lit(False))
    again = ~first & F.coalesce(F.col("position") > F.col("marked"), F.lit(False))
    at = rows.join(marks, kind, "left").withColumn("again", again)
    at = at.withColumn("asks", ~first & ~F.col("again") & ~F.coalesce(F.col("reason").isin(*UNSETTLED), F.lit(False)))
    counted = running(at, ["sender", "day"], ["batch", "position"], sent=F.col("asks") & F.col("reason").isNull() & (F.col("outcome") == "sent"))
    used = sent_before.select(F.coalesce("sender", F.lit(-1)).alias("sender"), "day", F.col("n").alias("used"))
    counted = counted.join(used, ["sender", "day"], "left").withColumn("sent", F.col("sent") + F.coalesce("used", F.lit(0)))
    stops = counted.where(F.col("asks") & (F.col("sent") >= limit)).groupBy(*batch).agg(F.min("position").alias("stop"))
    decision = (
        F.when(F.col("position") >= F.col("stop"), "daily limit")
        .when(first, F.col("reason"))
        .when(F.col("again"), "duplicate")
        .otherwise(F.coalesce("reason", "outcome"))
    )
    return counted.join(stops, batch, "left").select("email_id", decision.alias("decision"))


def draft_batches(requests: DataFrame, contacts: DataFrame, reasons: DataFrame, generated: DataFrame, limit: int) -> DataFrame:
    """Which requested contacts get a first draft: ``request_id, decision``.

    ``requests`` has request_id (the order), actor, day and contact_id; ``reasons`` contact_id and reason (null if none);
    ``generated`` actor, day and n, the drafts that the log already counts.  A contact that isn't there is not found; a
    second request for one that gets a draft on the day finds it contacted; the limit is the actor's on the day.
    """
    known = contacts.select("contact_id", F.lit(True).alias("known"))
    at = requests.join(known, "contact_id", "left").join(reasons, "contact_id", "left")
    at = at.withColumn("reason", F.when(F.col("known").isNull(), "not found").otherwise(F.col("reason")))
    firsts = at.where("reason is null").groupBy("actor", "day", "contact_id").agg(F.min("request_id").alias("first"))
    at = at.join(firsts, ["actor", "day", "contact_id"], "left")
    at = at.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("request_id") > F.col("first")), "already contacted").otherwise(F.col("reason")))
    counted = running(at, ["actor", "day"], ["request_id"], drafts=F.col("reason").isNull())
    used = generated.select("actor", "day", F.col("n").alias("used"))
    over = F.col("drafts") + F.coalesce("used", F.lit(0)) >= limit
    decided = F.coalesce("reason", F.when(over, "daily limit").otherwise("draft"))
    return counted.join(used, ["actor", "day"], "left").select("request_id", decided.alias("decision"))
