"""Gates, repairs and effects of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outlake.functions import identity, people
from outlake.operators import analytics
from outlake.operators.pipeline import has_evidence, may_have_left
from outlake.operators.prefix import following, running
from outlake.sources.store import written

# Columns that a wrong site empties, the wording of warnings, and states of companies that were never read.
PROFILE_COLUMNS = ("domain", "summary")
WARNING = "Verify this address really reaches"
UNSCRAPED = ("scrape_failed", "no_website", "wrong_site")


def attachment_conflicts(emails: DataFrame) -> DataFrame:
    """``email_id, reason``: why sending contradicts what the body says about its attachment, or null.

    ``emails`` has claims, resume_id, override_id, default_id and attach; a follow-up's premise is its original's, and
    sales mails never attach anything.
    """
    original = emails.select(F.col("email_id").alias("original_email_id"), F.col("email_type").alias("__original_type"))
    at = emails.join(original, "original_email_id", "left")
    kind = F.when(F.coalesce("is_follow_up", F.lit(False)), F.col("__original_type")).otherwise(F.col("email_type"))
    resolved = F.when(F.col("attach") & (F.coalesce(kind, F.lit("sales")) != "sales"), F.coalesce("override_id", "resume_id", "default_id"))
    expected = F.coalesce("resume_id", "default_id")
    reason = F.when(~F.col("claims"), None).when(resolved.isNull(), "nothing would be attached").when(resolved != expected, "another resume would be attached")
    return at.select("email_id", reason.alias("reason"))


def reconciled(emails: DataFrame, sent: DataFrame, slack_seconds: int = 60) -> DataFrame:
    """Pending attempts with the Sent-folder message that they left: equal recipient and subject, not before the attempt
    (less some slack), the earliest one; a message that another row records is nobody's.

    ``emails`` has recipient_email and subject, ``sent`` message_id, recipient, subject and at.
    """
    pending = emails.where(~has_evidence() & F.expr("send_attempted_at is not null and status <> 'trashed'"))
    free = sent.join(emails.where("gmail_message_id is not null").select(F.col("gmail_message_id").alias("message_id")), "message_id", "left_anti")
    # attempts and messages of a recipient and subject in order of time: an attempt takes what follows, no pairs are made
    moved = F.col("send_attempted_at") - F.make_dt_interval(secs=F.lit(float(slack_seconds)))
    tries = pending.select(F.lower("recipient_email").alias("to"), "subject", moved.alias("at"), F.lit(0).alias("side"), F.col("email_id").cast("string").alias("id"), "email_id", F.lit(None).cast("string").alias("message"))
    left = free.select(F.lower("recipient").alias("to"), "subject", "at", F.lit(1).alias("side"), F.col("message_id").alias("id"), F.lit(None).cast("long").alias("email_id"), F.col("message_id").alias("message"))
    both = tries.unionByName(left).where("to is not null and subject is not null")
    found = following(both, ["to", "subject"], ["at", "side", "id"], F.col("message")).where("side = 0").select("email_id", F.col("next").alias("message_id"))
    return pending.select("email_id").join(found, "email_id", "left").withColumn("outcome", F.when(F.col("message_id").isNotNull(), "delivered").otherwise("unknown"))


def deletion(companies: DataFrame, contacts: DataFrame, emails: DataFrame, force: bool = False) -> DataFrame:
    """``kind, id, outcome``: what deleting companies takes along.  A contact that was written to is kept, with its emails
    and its company, unless forced; everything else goes."""
    gone = companies.select("company_id")
    written = emails.where(may_have_left()).select("contact_id").where("contact_id is not null").distinct().withColumn("w", F.lit(not force))
    people_ = contacts.join(gone, "company_id", "left_semi").join(written, "contact_id", "left").select("contact_id", "company_id", F.coalesce("w", F.lit(False)).alias("stays"))
    mails = emails.select("email_id", "contact_id").join(people_.select("contact_id", "stays"), "contact_id")
    firms = gone.join(people_.groupBy("company_id").agg(F.bool_or("stays").alias("stays")), "company_id", "left")
    outcome = F.when(F.coalesce("stays", F.lit(False)), "protected").otherwise("deleted").alias("outcome")
    parts = [(firms, "company", "company_id"), (people_, "contact", "contact_id"), (mails, "email", "email_id")]
    first, *rest = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), outcome) for df, kind, key in parts]
    for part in rest:
        first = first.unionByName(part)
    return first


def linked_profiles(persons: DataFrame, links: DataFrame) -> DataFrame:
    """Persons of a page with its first profile link that fits their name.  ``persons`` has page_id, contact_id, person;
    ``links`` page_id, place, url."""
    named = written(persons.select("page_id", "contact_id", identity.name_tokens(F.col("person")).alias("tokens")).where(F.size("tokens") > 0))
    slugs = written(links.select("page_id", "place", "url", people.slug_parts(F.col("url")).alias("parts")).where("parts is not null"))
    # each name of a page meets each slug that shares a key with it, once: equal names and equal slugs are one
    names = named.select("page_id", "tokens").distinct().withColumn("key", F.explode(people.name_keys(F.col("tokens"))))
    first = slugs.groupBy("page_id", "parts").agg(F.min(F.struct("place", "url")).alias("x")).withColumn("key", F.explode(people.slug_keys(F.col("parts"))))
    # files say little of how large such rows are in memory: no broadcasts
    met = names.hint("merge").join(first, ["page_id", "key"]).where(people.parts_match_tokens(F.col("parts"), F.col("tokens")))
    best = met.groupBy("page_id", "tokens").agg(F.min("x").alias("x"))
    return named.hint("merge").join(best, ["page_id", "tokens"]).groupBy("page_id", "contact_id").agg(F.min("x")["url"].alias("url"))


def off_domain_notes(contacts: DataFrame, companies: DataFrame, emails: DataFrame) -> DataFrame:
    """``contact_id, action, note``: a warning for addresses off a trustworthy company domain whose owner never was
    written to; only blank notes are written, only own warnings cleared.  ``contacts`` has address and notes."""
    sent = emails.where("status = 'sent' and contact_id is not null").select("contact_id").distinct().withColumn("sent", F.lit(True))
    co = companies.select("company_id", F.col("name").alias("company_name"), F.coalesce(identity.registered_domain(F.col("domain")), F.lit("")).alias("home"), "scrape_status", people.domain_matches_name(F.col("name"), F.col("domain")).alias("trusted"))
    at = contacts.where(F.trim("address") != "").join(co, "company_id", "left").join(sent, "contact_id", "left")
    engaged = (F.col("status") == "replied") | F.coalesce("sent", F.lit(False))
    trusted = F.coalesce((F.col("home") != "") & (F.col("scrape_status") != "wrong_site") & F.col("trusted"), F.lit(False))
    own = F.coalesce(identity.registered_domain(identity.email_domain(F.col("address"))), F.lit("")) == F.col("home")
    warranted = trusted & ~own & ~engaged
    notes = F.trim(F.coalesce("notes", F.lit("")))
    text = F.concat(F.lit("Not on "), F.col("home"), F.lit(f". {WARNING} "), F.col("company_name"), F.lit(" before sending."))
    action = F.when(warranted & (notes == ""), "flag").when(~warranted & notes.startswith("Not on ") & notes.contains(WARNING), "clear").otherwise("keep")
    return at.select("contact_id", action.alias("action"), F.when(action == "flag", text).when(action == "keep", F.col("notes")).alias("note"))


def quarantined(companies: DataFrame) -> DataFrame:
    """Companies whose domain isn't theirs lose it and what was read there; others stay."""
    bad = F.coalesce(F.col("domain"), F.lit("")) != ""
    bad &= (F.col("scrape_status") == "wrong_site") | ~people.domain_matches_name(F.col("name"), F.col("domain"))
    out = companies.withColumn("__bad", bad)
    out = out.withColumns({c: F.when(~F.col("__bad"), F.col(c)) for c in PROFILE_COLUMNS if c in companies.columns})
    return out.withColumn("scrape_status", F.when(F.col("__bad"), "wrong_site").otherwise(F.col("scrape_status"))).drop("__bad")


def dive_saved(fresh: DataFrame, companies: DataFrame) -> DataFrame:
    """Company columns after a dive is saved.  A trusted one overwrites (a domain only if it has one), contacts-only dives keep the research, an untrusted
    one keeps what was there, and a new company on a wrong site gets neither domain nor summary.

    ``fresh`` has company_id, new_domain, new_summary, status, identity_ok and contacts_only; ``companies`` domain,
    summary and scrape_status.
    """
    at = fresh.join(companies.select("company_id", "domain", "summary", "scrape_status", F.lit(True).alias("known")), "company_id", "left")
    trusted = F.col("identity_ok") & (F.col("status") != "wrong_site")
    keeps = F.col("contacts_only") & F.col("known").isNotNull()
    takes = trusted & ~keeps
    prior = F.col("known").isNotNull()
    return at.select(
        "company_id",
        F.when(takes, F.coalesce("new_domain", "domain")).when(prior, F.col("domain")).alias("domain"),
        F.when(takes, F.col("new_summary")).when(prior, F.col("summary")).alias("summary"),
        F.when(takes, F.col("status")).when(prior, F.col("scrape_status")).otherwise(F.col("status")).alias("scrape_status"),
        F.when(trusted, "saved").when(prior, "kept").otherwise("blank").alias("outcome"),
    )


def summaries_to_notes(companies: DataFrame) -> DataFrame:
    """Summaries of companies that were never read become notes, unless there is one."""
    moved = (F.coalesce("summary", F.lit("")) != "") & F.col("discovery_note").isNull() & F.col("scrape_status").isin(*UNSCRAPED)
    out = companies.withColumn("__moved", moved)
    return out.withColumns({"discovery_note": F.when(F.col("__moved"), F.col("summary")).otherwise(F.col("discovery_note")), "summary": F.when(~F.col("__moved"), F.col("summary"))}).drop("__moved")


def unverified_report(emails: DataFrame) -> DataFrame:
    """One row: reply flags that nothing verified, and how many of them a batch stamped."""
    flags = emails.where("has_response and response_verified_at is null").select("email_id")
    stamped = analytics.batch_stamped_rows(emails, 3).select("email_id").withColumn("s", F.lit(True))
    return flags.join(stamped, "email_id", "left").agg(F.count("*").alias("unverified"), F.count("s").alias("batch_stamped"))


def research_status(has_site: Column, ours: Column, read: Column, reachable: Column) -> Column:
    """no_website, wrong_site, scrape_failed, or scraped if somebody can be reached, else no_emails_found."""
    return F.when(~has_site, "no_website").when(~ours, "wrong_site").when(~read, "scrape_failed").when(reachable, "scraped").otherwise("no_emails_found")


def channels_met(rows: DataFrame, floor: int, target: int) -> DataFrame:
    """Per company how many people have a channel that can be used, and whether that meets the floor and the target.
    ``rows`` has company_id, known, person and name_from_email."""
    k = F.col("known")
    email = (k["kind"] != "none") & (k["kind"] != "generic") & (k["email_verified"] | k["person_match"])
    named = (F.col("person") != "") & ~F.col("name_from_email")
    n = F.count_if(named & (email | k["profile_verified"])).cast("long")
    g = rows.groupBy("company_id").agg(n.alias("usable"), F.count_if(named & email).cast("long").alias("by_email"), F.count_if(named & k["profile_verified"]).cast("long").alias("by_profile"))
    return g.withColumn("floor_met", F.col("usable") >= floor).withColumn("target_met", F.col("usable") >= target)


def _emailed(emails: DataFrame) -> DataFrame:
    return emails.where(may_have_left() & F.expr("contact_id is not null")).select("contact_id").distinct().withColumn("emailed", F.lit(True))


def research_merge(candidates: DataFrame, contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """What new research fills in: ``contact_id`` with the email, kind and name after it.  Blanks are filled; an address
    only if nothing was ever sent, a generic one only for a personal one.  ``candidates`` has contact_id, address, person
    and known; ``contacts`` email, email_kind and name."""
    c = candidates.select("contact_id", F.trim("address").alias("new"), F.col("person").alias("new_name"), "known")
    at = contacts.select("contact_id", F.trim(F.coalesce("email", F.lit(""))).alias("old"), "email_kind", "name").join(c, "contact_id").join(_emailed(emails), "contact_id", "left")
    free = F.col("emailed").isNull()
    upgrade = (F.col("email_kind") == "generic") & (F.col("known.kind") == "personal") & (F.col("known.email_verified") | F.col("known.person_match"))
    given = F.coalesce("new", F.lit("")) != ""
    takes = given & free & ((F.col("old") == "") | ((F.lower("old") != F.lower("new")) & upgrade))
    same = given & (takes | (F.lower("old") == F.lower("new")))
    return at.select(
        "contact_id", F.when(takes, F.col("new")).otherwise(F.col("old")).alias("email"), F.when(same, F.col("known.kind")).otherwise(F.col("email_kind")).alias("email_kind"),
        F.coalesce(F.nullif("name", F.lit("")), F.col("new_name")).alias("name"),
    )


def contact_edits(edits: DataFrame, contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """What edits of addresses do: ``contact_id, outcome, clears_bounce, dropped_schedules, cleared_rows``.  An address that
    was written to only changes if forced; a change clears the bounce of the contact and of rows sent to the old address,
    and takes queued emails off the schedule.  ``edits`` has contact_id, new_email and force."""
    now = contacts.select("contact_id", F.lower(F.trim(F.coalesce("email", F.lit("")))).alias("old"), F.col("bounced_at").alias("cb"))
    at = edits.join(now, "contact_id").join(_emailed(emails), "contact_id", "left")
    differs = F.lower(F.trim("new_email")) != F.col("old")
    outcome = F.when(~differs, "same").when(F.col("emailed").isNotNull() & ~F.col("force"), "refused").otherwise("changed")
    at = at.withColumn("outcome", outcome)
    mails = emails.where("contact_id is not null").join(at.select("contact_id", "old"), "contact_id").groupBy("contact_id").agg(
        F.count_if(F.col("scheduled_at").isNotNull()).cast("long").alias("q"), F.count_if(F.col("bounced_at").isNotNull() & (F.col("recipient_email").isNull() | (F.lower("recipient_email") == F.col("old")))).cast("long").alias("b")
    )
    out = at.join(mails, "contact_id", "left")
    changed = F.col("outcome") == "changed"
    count = lambda c: F.when(changed, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return out.select("contact_id", "outcome", (changed & F.col("cb").isNotNull()).alias("clears_bounce"), count("q").alias("dropped_schedules"), count("b").alias("cleared_rows"))


def affinities(context: Column, schools: list[str], groups: list[str]) -> Column:
    """A school that a text names, and shared groups as whole words, in order."""
    lower = F.lower(F.coalesce(context, F.lit("")))
    school = F.lit(False)
    for s in schools:
        school |= lower.contains(s.lower())
    found = [F.when(school, F.lit(schools[0]))] if schools else []
    spaced = F.concat(F.lit(" "), F.regexp_replace(lower, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    found += [F.when(spaced.contains(f" {g.lower()} "), F.lit(f"Shared: {g}")) for g in groups if len(g) >= 3]
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


# Sentences of notes, which are stored and read back.
WARM = ("Warm match: ", ". Verify before referencing it.")
EMAIL_SURE = "Email verified as person-associated (name match + MX confirmed)."
EMAIL_LIKELY = "Email local matches name; MX not confirmed yet."
EMAIL_ROLE = "Company/role inbox — not a specific person."
EMAIL_UNCLEAR = "Email local-part does not clearly match this person's name."
PROFILE_SURE = "LinkedIn URL slug matches this person's name."
PROFILE_UNCLEAR = "LinkedIn URL did not match this person's name — not stored as verified."
SOURCE = "Source: "


def provenance(known: Column, address: Column, profile: Column, affinity: Column, source: Column) -> Column:
    """Where a person comes from and what is sure about their channels, as one note; null if there is nothing to say."""
    warm = F.transform(affinity, lambda a: F.concat(F.lit(WARM[0]), a, F.lit(WARM[1])))
    email = (
        F.when(known["email_verified"], EMAIL_SURE)
        .when(known["person_match"], EMAIL_LIKELY)
        .when(known["kind"] == "generic", EMAIL_ROLE)
        .when(F.trim(address) != "", EMAIL_UNCLEAR)
    )
    url = F.when(known["profile_verified"], PROFILE_SURE).when(F.coalesce(profile, F.lit("")) != "", PROFILE_UNCLEAR)
    parts = F.concat(warm, F.array(email, url, F.concat(F.lit(SOURCE), source)))
    return F.nullif(F.array_join(F.filter(parts, lambda x: x.isNotNull()), " "), F.lit(""))


def queue_order(emails: DataFrame) -> DataFrame:
    """Place of each queued email of a sender in the order in which it goes out."""
    queued = emails.where(F.col("scheduled_at").isNotNull() & ~has_evidence() & (F.col("status") != "trashed"))
    placed = running(queued.select("email_id", "company_id", "scheduled_at"), ["company_id"], ["scheduled_at", "email_id"], place=F.lit(1))
    return placed.select("email_id", "company_id", (F.col("place") + 1).alias("place"))
