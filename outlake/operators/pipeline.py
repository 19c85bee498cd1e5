"""The pipeline board: evidence per contact, stages, drift, totals and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outlake.operators.analytics import unverified_reply, verified_reply

STAGES = ("ready", "drafted", "awaiting", "replied", "bounced", "no_address", "archived")


# Three meanings of "delivered"; they are not interchangeable.


def has_evidence() -> Column:
    return F.expr("coalesce(trim(gmail_message_id), '') <> '' or sent_at is not null")


def counts_as_sent() -> Column:
    return F.expr("gmail_message_id is not null or sent_at is not null or status = 'sent'")


def may_have_left() -> Column:
    return F.expr("status = 'sent' or gmail_message_id is not null or send_attempted_at is not null")


def attempt_pending() -> Column:
    return ~has_evidence() & F.expr("send_attempted_at is not null")


def is_follow_up_row() -> Column:
    return F.expr("coalesce(is_follow_up, false) or original_email_id is not null")


def _n(c: Column) -> Column:
    return F.count_if(c).cast("long")


def evidence(contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """One row per contact with the counts that decide its stage.  Emails are aggregated once, after meeting the
    contact's current address: a bounce belongs to an address."""
    now = contacts.select("contact_id", F.lower(F.coalesce("email", F.lit(""))).alias("__now"))
    e = emails.where("contact_id is not null").join(now, "contact_id")
    unsent = F.expr("status in ('draft', 'approved')")
    counts = e.groupBy("contact_id").agg(
        _n(unsent & F.expr("scheduled_at is null and send_attempted_at is null") & ~has_evidence()).alias("pending_draft_count"),
        _n(F.expr("scheduled_at is not null and status <> 'trashed'") & ~has_evidence()).alias("queued_count"),
        _n(attempt_pending() & F.expr("status <> 'trashed'")).alias("unconfirmed_count"),
        _n(counts_as_sent()).alias("delivered_count"),
        _n(F.expr("bounced_at is not null and lower(coalesce(recipient_email, __now)) = __now")).alias("bounced_email_count"),
        _n(verified_reply()).alias("verified_reply_count"),
        _n(unverified_reply()).alias("unverified_reply_count"),
        _n(is_follow_up_row() & counts_as_sent()).alias("follow_up_count"),
        F.max("sent_at").alias("last_sent_at"),
    )
    out = contacts.join(counts, "contact_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts.columns if c.endswith("_count")})


def stage() -> Column:
    return F.expr(
        "case when lower(trim(coalesce(status, ''))) = 'archived' then 'archived' when verified_reply_count > 0 then 'replied' "
        "when bounced_at is not null or bounced_email_count > 0 then 'bounced' when trim(coalesce(email, '')) = '' then 'no_address' "
        "when pending_draft_count > 0 or queued_count > 0 then 'drafted' when delivered_count > 0 or unconfirmed_count > 0 then 'awaiting' else 'ready' end"
    )


def drifts(stage_col: str = "stage") -> Column:
    """Whether the stored status says something else than the stage; statuses that can't be translated never do."""
    stored = (
        "case lower(trim(coalesce(status, ''))) when 'new' then 'ready' when 'drafted' then 'drafted' when 'sent' then 'awaiting' "
        "when 'replied' then 'replied' when 'archived' then 'archived' end"
    )
    fits = (
        f"case {stage_col} when 'no_address' then array('ready', 'drafted') "
        f"when 'bounced' then array('awaiting', 'ready', 'drafted') else array({stage_col}) end"
    )
    return F.expr(f"coalesce(not array_contains({fits}, {stored}), false)")


def board(contacts: DataFrame, emails: DataFrame) -> DataFrame:
    return evidence(contacts, emails).withColumn("stage", stage()).withColumn("drift", drifts())


def board_totals(board_rows: DataFrame, shown: int = 100) -> DataFrame:
    """Every stage with its total, what its column hides, drift and queue; stages without contacts stay."""
    stages = board_rows.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    t = board_rows.groupBy("stage").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("drift")).cast("long").alias("drifted"),
        F.sum("queued_count").alias("queued"),
        F.count_if(F.expr("stage = 'ready' or (stage = 'drafted' and pending_draft_count > 0)")).cast("long").alias("waiting_on_you"),
    )
    out = stages.join(t, "stage", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "drifted", "queued", "waiting_on_you")]
    return out.select("stage", *zero).withColumn("hidden", F.greatest(F.lit(0).cast("long"), F.col("total") - shown))


def cards(board_rows: DataFrame, shown: int = 100) -> DataFrame:
    """The cards that each stage shows: last written to first, never written to last, then by name."""
    order = W.partitionBy("stage").orderBy(F.desc_nulls_last("last_sent_at"), F.lower("name"), "contact_id")
    ranked = board_rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= shown)
    return ranked.select(
        "stage", "place", "contact_id", F.coalesce(F.nullif("name", F.lit("")), F.nullif("email", F.lit("")), F.lit("Unnamed contact")).alias("name"),
        F.expr("unverified_reply_count > 0 and verified_reply_count = 0").alias("reply_unverified"),
        F.expr("pending_draft_count > 0 and trim(coalesce(email, '')) = ''").alias("blocked_draft"),
    )


def company_counts(companies: DataFrame, contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """Contacts, sent emails and replies of each company, reached through its contacts."""
    mail = emails.where("contact_id is not null").groupBy("contact_id").agg(
        _n(F.expr("status = 'sent'")).alias("sent"), _n(verified_reply()).alias("replied"), _n(unverified_reply()).alias("unverified")
    )
    per = contacts.select("contact_id", "company_id").join(mail, "contact_id", "left").groupBy("company_id").agg(
        F.count("*").alias("contacts"), *[F.sum(c).alias(c) for c in ("sent", "replied", "unverified")]
    )
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("contacts", "sent", "replied", "unverified")]
    return companies.select("company_id", "name").join(per, "company_id", "left").select("company_id", "name", *counts)


def contact_counts(contacts: DataFrame, emails: DataFrame) -> DataFrame:
    mail = emails.groupBy("contact_id").agg(
        F.count("*").alias("emails"), F.max("sent_at").alias("last_sent_at"), _n(verified_reply()).alias("replied"), _n(unverified_reply()).alias("unverified")
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("emails", "replied", "unverified")]
    return contacts.select("contact_id").join(mail, "contact_id", "left").select("contact_id", "last_sent_at", *counts)


def decorated(emails: DataFrame, contacts: DataFrame, companies: DataFrame, flags: DataFrame | None = None, follow_ups: DataFrame | None = None) -> DataFrame:
    """Emails with names; the recipient frozen on the row wins over the contact's present address.  ``flags`` (per contact)
    and ``follow_ups`` (per email) add what hangs on each email."""
    ct = contacts.select("contact_id", F.col("name").alias("contact_name"), F.col("email").alias("__email"), F.col("company_id").alias("__co"))
    co = companies.select(F.col("company_id").alias("__co"), F.col("name").alias("company_name"))
    out = emails.join(ct, "contact_id", "left").join(co, "__co", "left")
    shown = ["email_id", F.coalesce("recipient_email", "__email").alias("recipient"), "contact_name", "company_name"]
    if flags is not None and follow_ups is not None:
        own = ("replied", "reply_unverified", "follow_up_pending")
        out = out.join(flags.select("contact_id", *own, "follow_ups_sent"), "contact_id", "left").join(follow_ups, "email_id")
        shown += ["has_follow_up", *[F.coalesce(c, F.lit(False)).alias(c) for c in own], F.coalesce("follow_ups_sent", F.lit(0)).alias("follow_ups_sent")]
    return out.select(*shown)


def tabs(emails: DataFrame) -> DataFrame:
    """The mailbox tab that each email is shown in."""
    tab = (
        F.when(F.expr("status = 'trashed'"), "trashed")
        .when(F.col("scheduled_at").isNotNull() & ~has_evidence(), "queued")
        .when(F.expr("status = 'sent'") | has_evidence(), "sent")
        .when(F.expr("status in ('draft', 'approved')"), "drafts")
    )
    return emails.select("email_id", tab.alias("tab"))
