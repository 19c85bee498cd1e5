"""Follow-ups: flags per contact, the due list, plans and roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlake.operators.pipeline import is_follow_up_row
from outlake.operators.suppression import match
from outlake.sources.store import written


def contact_flags(emails: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row per contact that has emails, with everything that follow-up rules ask about it."""
    now = contacts.select("contact_id", F.lower(F.coalesce("email", F.lit(""))).alias("__now"))
    e = emails.where("contact_id is not null").join(now, "contact_id", "left").withColumn("f", is_follow_up_row())
    return e.groupBy("contact_id").agg(
        F.expr("coalesce(bool_or(f and status = 'sent' and sent_at is null), false)").alias("undated_follow_up"),
        F.expr("coalesce(bool_or(has_response and response_verified_at is not null), false)").alias("replied"),
        F.expr("coalesce(bool_or(has_response and response_verified_at is null), false)").alias("reply_unverified"),
        F.expr("coalesce(bool_or(bounced_at is not null and lower(coalesce(recipient_email, __now, '')) = __now), false)").alias("bounced_now"),
        F.expr("coalesce(bool_or(f and status <> 'sent'), false)").alias("unsent_follow_up"),
        F.expr("coalesce(bool_or(f and status not in ('sent', 'trashed')), false)").alias("follow_up_pending"),
        F.expr("count_if(status = 'sent')").cast("long").alias("n_sent"),
        F.expr("count_if(f and status = 'sent')").cast("long").alias("follow_ups_sent"),
        F.expr("max_by(email_id, struct(coalesce(sent_at, timestamp_ntz '1970-01-01 00:00:00'), email_id)) filter (where status = 'sent')").alias("previous_email_id"),
    )


def has_follow_up(emails: DataFrame) -> DataFrame:
    """``email_id, has_follow_up``: a follow-up that isn't trashed hangs on this email or on its contact."""
    follow = emails.where(is_follow_up_row() & F.expr("status <> 'trashed'"))
    by_original = follow.select(F.col("original_email_id").alias("email_id")).where("email_id is not null").distinct().withColumn("o", F.lit(True))
    by_contact = follow.select("contact_id").where("contact_id is not null").distinct().withColumn("c", F.lit(True))
    out = emails.select("email_id", "contact_id").join(by_original, "email_id", "left").join(by_contact, "contact_id", "left")
    return out.select("email_id", F.expr("coalesce(o, false) or coalesce(c, false)").alias("has_follow_up"))


def due(emails: DataFrame, contacts: DataFrame, steps: list[int], as_of: str, days: int | None = None) -> DataFrame:
    """Contacts that a follow-up is due for: their anchor email, rung, last touch and whole days since."""
    flags = contact_flags(emails, contacts).select("contact_id", "undated_follow_up", "replied", "bounced_now", "unsent_follow_up")
    ct = contacts.select("contact_id", F.col("bounced_at").alias("__cb"), F.col("follow_ups_declined_at").alias("__cd"))
    sent = emails.where("status = 'sent' and sent_at is not null").join(ct, "contact_id", "left").join(flags, "contact_id", "left")
    open_ = sent.where("__cb is null and __cd is null and not coalesce(undated_follow_up or replied or bounced_now or unsent_follow_up, false)")
    g = open_.withColumn("f", is_follow_up_row()).groupBy(F.expr("coalesce(cast(contact_id as string), concat('email:', email_id))").alias("who")).agg(
        F.min("contact_id").alias("contact_id"),
        F.expr("count_if(f)").cast("long").alias("follow_ups_sent"),
        F.max("sent_at").alias("last_touch_at"),
        F.expr("max_by(email_id, struct(sent_at, -email_id)) filter (where not f and not coalesce(has_response, false))").alias("email_id"),
    )
    gaps = F.array(*[F.lit(x) for x in steps])
    g = g.withColumn("step", F.col("follow_ups_sent") + 1).where((F.col("step") <= len(steps)) & F.col("email_id").isNotNull())
    gap = F.get(gaps, (F.col("step") - 1).cast("int")) if days is None else F.lit(days)
    now = F.expr(as_of).cast("timestamp_ntz")
    late = F.col("last_touch_at").cast("timestamp_ntz") < now - F.make_dt_interval(gap)
    since = F.floor(F.timestamp_diff("SECOND", F.col("last_touch_at").cast("timestamp_ntz"), now) / 86400).cast("long")
    return g.where(late).select("contact_id", "email_id", "follow_ups_sent", "step", F.lit(len(steps)).cast("long").alias("steps_total"), "last_touch_at", since.alias("days_since_touch"))


def plan(contacts: DataFrame, emails: DataFrame, suppressions: DataFrame, steps: list[int], manual: bool) -> DataFrame:
    """Per contact the first refusal, or the next rung and the email that it follows."""
    flags = contact_flags(emails, contacts)
    blocked = match(contacts, suppressions, "contact_id", "email").select("contact_id", F.lit(True).alias("__blocked"))
    c = contacts.select("contact_id", "bounced_at", "follow_ups_declined_at").join(flags, "contact_id", "left").join(blocked, "contact_id", "left")
    unsent = "follow_up_pending" if manual else "unsent_follow_up"
    refusal = (
        F.when(F.expr("coalesce(replied, false)"), "replied")
        .when(F.expr("bounced_at is not null or coalesce(bounced_now, false)"), "bounced")
        .when(F.expr("coalesce(__blocked, false)"), "suppressed")
        .when(F.lit(not manual) & F.expr("follow_ups_declined_at is not null"), "declined")
        .when(F.expr(f"coalesce({unsent}, false)"), "already drafted")
        .when(F.expr("coalesce(n_sent, 0) = 0"), "nothing sent")
        .when(F.expr(f"coalesce(follow_ups_sent, 0) >= {len(steps)}"), "cadence finished")
    )
    out = c.withColumn("refusal", refusal if steps else F.lit("off"))
    free = F.col("refusal").isNull()
    return out.select("contact_id", "refusal", F.when(free, F.col("follow_ups_sent") + 1).alias("step"), F.when(free, F.col("previous_email_id")).alias("previous_email_id"))


def _ends(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the chains of ``links`` (id, parent) end, as ``id, root``, and ``id, to`` of those that never do.

    Pointers are doubled: a round joins each row's pointer with the pointer that it leads to, so chains of any length end
    after the logarithm of it.  What still moves after as many rounds as the longest chain could need leads into a cycle,
    and ``to`` is then a row of the cycle.
    """
    at, most = links.select("id", F.col("parent").alias("to"), F.lit(True).alias("moved")), links.count().bit_length() + 1
    for _ in range(most):
        step = at.join(at.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left")
        at = written(step.select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
    return at.where("not moved").select("id", F.col("to").alias("root")), at.where("moved").select("id", "to")


def roots(emails: DataFrame) -> DataFrame:
    """``email_id, root_id``: the parent chain of follow-ups, stopping at a missing parent, or before a row that it has
    been at.

    Chains that lead into a cycle stop at the last row of the cycle that they come to: the one before the row where they
    enter it.  As many steps as there are rows lead from anywhere exactly to the rows of cycles; without their links every
    chain ends where it enters one.
    """
    links = emails.where(is_follow_up_row()).select(F.col("email_id").alias("id"), F.col("original_email_id").alias("parent"))
    known = emails.select(F.col("email_id").alias("parent"))
    links = written(links.join(known, "parent", "left_semi").select("id", "parent").where("id <> parent"))
    found, moving = _ends(links)
    if not moving.isEmpty():
        cycles = written(moving.select(F.col("to").alias("id")).distinct())
        before = links.join(cycles, "id", "left_semi").select(F.col("id").alias("last"), F.col("parent").alias("entry"))
        into, _ = _ends(written(links.join(moving.select("id"), "id", "left_semi").join(cycles, "id", "left_anti")))
        entries = into.select("id", F.col("root").alias("entry")).unionByName(cycles.select("id", F.col("id").alias("entry")))
        found = found.unionByName(entries.join(before, "entry").select("id", F.col("last").alias("root")))
    return emails.select("email_id").join(found, F.col("email_id") == F.col("id"), "left").select("email_id", F.coalesce("root", "email_id").alias("root_id"))
