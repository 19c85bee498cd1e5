"""Decisions by the first rule that holds (G2, G4), and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outlake.operators.followups import contact_flags
from outlake.operators.pipeline import attempt_pending, has_evidence, is_follow_up_row
from outlake.operators.sending import send_batches
from outlake.operators.suppression import match
from outlake.sources.store import written


def draft_reasons(contacts: DataFrame, emails: DataFrame, suppressions: DataFrame) -> DataFrame:
    """``contact_id, company_id, reason``: the first rule that refuses a contact's first draft, or null."""
    contacted = emails.where(~is_follow_up_row()).where("status in ('sent', 'draft', 'approved') and contact_id is not null").select("contact_id", F.lit(True).alias("__written")).distinct()
    blocked = match(contacts, suppressions, "contact_id", "email").select("contact_id", F.lit(True).alias("__blocked"))
    at = contacts.join(blocked, "contact_id", "left").join(contacted, "contact_id", "left")
    reason = (
        F.when(F.expr("trim(coalesce(email, '')) = ''"), "no email").when(F.col("__blocked"), "suppressed").when(F.expr("status = 'archived'"), "archived").when(F.col("__written"), "already contacted")
    )
    return at.select("contact_id", "company_id", reason.alias("reason"))


def draft_gate(contacts: DataFrame, emails: DataFrame, suppressions: DataFrame, cap: int) -> DataFrame:
    """Which contacts get a first draft: ``contact_id, decision``.  The cap counts survivors per company and cuts the
    rest; ``sending.draft_batches`` has the limit per actor and day."""
    at = draft_reasons(contacts, emails, suppressions)
    place = F.row_number().over(W.partitionBy("company_id").orderBy("contact_id"))
    free = at.where("reason is null").select("contact_id", F.when(place > cap, "daily cap").otherwise("draft").alias("decision"))
    return free.unionByName(at.where("reason is not null").select("contact_id", F.col("reason").alias("decision")))


def send_reasons(emails: DataFrame, contacts: DataFrame, suppressions: DataFrame) -> DataFrame:
    """``email_id, is_follow_up, to, reason``: the first rule of the row itself that refuses an email, or null."""
    flags = contact_flags(emails, contacts).select("contact_id", "replied", "bounced_now")
    ct = contacts.select("contact_id", F.col("email").alias("__email"), F.col("bounced_at").alias("__cb"))
    rows = emails.join(ct, "contact_id", "left").join(flags, "contact_id", "left").withColumn("__to", F.coalesce("recipient_email", "__email"))
    # the list is asked once for each address that is written to, however many emails go there
    asked = contacts.select(F.col("email").alias("__to")).unionByName(emails.select(F.col("recipient_email").alias("__to"))).distinct()
    blocked = match(asked, suppressions, "__to", "__to").select("__to", F.lit(True).alias("__blocked"))
    reason = (
        F.when(F.expr("status not in ('draft', 'approved')"), "not sendable")
        .when(has_evidence(), "already delivered")
        .when(attempt_pending(), "attempt pending")
        .when(F.expr("coalesce(replied, false)"), "replied")
        .when(F.col("__blocked"), "suppressed")
        .when(F.expr("__cb is not null or coalesce(bounced_now, false)"), "bounced")
        .when(F.expr("trim(coalesce(__to, '')) = ''"), "no address")
    )
    return rows.join(blocked, "__to", "left").select("email_id", "is_follow_up", F.lower("__to").alias("to"), reason.alias("reason"))


def send_gate(emails: DataFrame, contacts: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Why each email may not be sent, or ``send``: ``email_id, decision``.  Row-local rules come before the window over survivors."""
    at = send_reasons(emails, contacts, suppressions)
    place = F.row_number().over(W.partitionBy("to", "is_follow_up").orderBy("email_id"))
    free = at.where("reason is null").select("email_id", F.when(place > 1, "duplicate").otherwise("send").alias("decision"))
    return free.unionByName(at.where("reason is not null").select("email_id", F.col("reason").alias("decision")))


def send_gate_in_full(emails: DataFrame, contacts: DataFrame, suppressions: DataFrame, acceptance: DataFrame, reconciled: DataFrame, queue: DataFrame, sent_before: DataFrame, limit: int) -> DataFrame:
    """What becomes of queued emails: the rules of the row, what attempts left (``reconciled``: email_id, outcome), mail
    acceptance by domain (only a refusal blocks), then batches in order under the limit of each sender and day.

    ``queue`` has email_id, sender, day, batch, position and outcome; see ``sending.send_batches``.
    """
    left = reconciled.select("email_id", F.col("outcome").alias("__left"))
    at = send_reasons(emails, contacts, suppressions).withColumn("domain", F.substring_index("to", "@", -1))
    at = at.join(acceptance, "domain", "left").join(left, "email_id", "left")
    reason = F.when((F.col("reason") == "attempt pending") & (F.col("__left") == "delivered"), "reconciled").when(F.col("reason").isNull() & ~F.coalesce("accepts", F.lit(True)), "no mail acceptance")
    judged = at.select("email_id", "is_follow_up", F.col("to").alias("recipient"), F.coalesce(reason, "reason").alias("reason"))
    return send_batches(written(queue.join(judged, "email_id")), sent_before, limit)


def delivered_to_sent(emails: DataFrame) -> DataFrame:
    """Rows with delivery evidence get the status sent."""
    return emails.withColumn("status", F.when(has_evidence(), "sent").otherwise(F.col("status")))


def replied_contacts(contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """Contacts with a verified reply get the status replied; nothing is ever downgraded."""
    back = emails.where("has_response and response_verified_at is not null").select("contact_id", F.lit(True).alias("__r")).distinct()
    return contacts.join(back, "contact_id", "left").withColumn("status", F.when(F.col("__r") & (F.col("status") != "archived"), "replied").otherwise(F.col("status"))).drop("__r")


def protected_delete(wanted: DataFrame, emails: DataFrame) -> DataFrame:
    """Rows that go and rows that are kept because mail was sent (J18): ``contact_id, outcome``."""
    sent = emails.where("status = 'sent' or gmail_message_id is not null or send_attempted_at is not null").select("contact_id", F.lit(True).alias("__sent")).distinct()
    return wanted.join(sent, "contact_id", "left").select("contact_id", F.when(F.col("__sent"), "protected").otherwise("deleted").alias("outcome"))


def acceptance_gate(contacts: DataFrame, domains: DataFrame) -> DataFrame:
    """Only a domain known to refuse mail blocks; an unknown one passes."""
    rows = contacts.select("contact_id", F.lower(F.substring_index("email", "@", -1)).alias("domain"))
    return rows.join(domains, "domain", "left").select("contact_id", F.coalesce("accepts", F.lit(True)).alias("passes"))
