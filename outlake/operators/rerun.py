"""What a run of research changes: contacts that are known already, company columns, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlake.functions import people
from outlake.operators.pipeline import may_have_left

#: Columns that describe a company; what records the attempt survives a wrong site.
PROFILE = ("url", "domain", "summary", "industry")
ATTEMPT = ("pages_scraped", "pages_attempted", "research_quality")


def merged_contacts(candidates: DataFrame, contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """What new research fills in of known contacts, one row each: their columns after it, and ``conflict``, the contact
    that has the profile which couldn't be attached.

    - Blank names, roles and notes are filled, and a blank profile, unless another contact has it.
    - An address is taken if there is none, or a personal one that is verified or fits the name in place of a generic one;
      in both cases only while nothing was sent.
    - Kind and verification of the address change only if the stored address is the candidate's, before or after.
    - The person counts as verified by the candidate only if a verified address or a new profile comes with it.

    ``candidates`` has contact_id, address, profile (usable channels), person, title, note and known; ``contacts``
    contact_id, name, role, address, profile, email_kind, email_verified, person_verified and notes.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    url = lambda c: F.nullif(F.lower(people.stored_profile(F.col(c))), F.lit(""))
    emailed = emails.where(may_have_left() & F.expr("contact_id is not null")).select("contact_id").distinct().withColumn("emailed", F.lit(True))
    owners = contacts.select(url("profile").alias("new_url"), F.col("contact_id").alias("owner")).where("new_url is not null").groupBy("new_url").agg(F.min("owner").alias("owner"))
    new = candidates.select("contact_id", F.trim(F.coalesce("address", F.lit(""))).alias("new_address"), F.col("profile").alias("new_profile"), url("profile").alias("new_url"), F.col("person").alias("new_name"), F.col("title").alias("new_role"), F.col("note").alias("new_note"), "known")
    at = contacts.join(new, "contact_id").join(emailed, "contact_id", "left").join(owners, "new_url", "left")
    old = F.trim(F.coalesce("address", F.lit("")))
    given, free = F.col("new_address") != "", F.col("emailed").isNull()
    better = (F.col("email_kind") == "generic") & (F.col("known.kind") == "personal") & (F.col("known.email_verified") | F.col("known.person_match"))
    takes = given & free & ((old == "") | ((F.lower(old) != F.lower("new_address")) & better))
    same = given & (takes | ((old != "") & (F.lower(old) == F.lower("new_address"))))
    wants = blank(F.col("profile")) & F.col("new_url").isNotNull()
    taken = F.col("owner").isNotNull() & (F.col("owner") != F.col("contact_id"))
    at = at.withColumn("takes", takes).withColumn("same", same).withColumn("attaches", wants & ~F.coalesce(taken, F.lit(False)))
    fill = lambda own, other: F.when(blank(F.col(own)) & ~blank(F.col(other)), F.col(other)).otherwise(F.col(own)).alias(own)
    sure = (F.col("same") & F.col("known.email_verified")) | F.col("attaches")
    return at.select(
        "contact_id", fill("name", "new_name"), fill("role", "new_role"), fill("notes", "new_note"),
        F.when(F.col("takes"), F.col("new_address")).otherwise(old).alias("address"),
        F.when(F.col("attaches"), F.col("new_profile")).otherwise(F.col("profile")).alias("profile"),
        F.when(F.col("same"), F.col("known.kind")).otherwise(F.col("email_kind")).alias("email_kind"),
        F.when(F.col("same"), F.col("known.email_verified")).otherwise(F.col("email_verified")).alias("email_verified"),
        F.when(sure, F.col("known.person_verified")).otherwise(F.col("person_verified")).alias("person_verified"),
        F.when(wants & taken, F.col("owner")).alias("conflict"),
    )


def company_columns(companies: DataFrame, results: DataFrame, status: Column) -> DataFrame:
    """Companies after a result: what it found replaces what is stored, what it didn't find stays; on the wrong site the
    description goes, so that a later run searches again, and what records the attempt stays.  ``status`` is over the
    result's columns (``new_`` and the name) and says no_website, wrong_site and so on."""
    new = results.select("company_id", *[F.col(c).alias(f"new_{c}") for c in results.columns if c != "company_id"])
    at = companies.join(new, "company_id", "left").withColumn("__status", F.when(F.col("new_found"), status))
    after = lambda c: F.coalesce(f"new_{c}", c)
    described = [F.when(F.coalesce(F.col("__status") == "wrong_site", F.lit(False)), None).otherwise(after(c)).alias(c) for c in PROFILE]
    return at.select("company_id", *described, *[after(c).alias(c) for c in ATTEMPT], F.coalesce("__status", "scrape_status").alias("scrape_status"))


def discovery_tally(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """Of each status of a discovery run how many companies it has, and the contacts and addresses found there."""
    found = contacts.groupBy("company_id").agg(F.count("*").alias("contacts"), F.count_if(F.trim(F.coalesce("address", F.lit(""))) != "").cast("long").alias("emails"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return companies.join(found, "company_id", "left").groupBy("scrape_status").agg(F.count("*").alias("companies"), n("contacts"), n("emails"))


def page_counters(pages: DataFrame, most: int) -> DataFrame:
    """Per company pages tried and read, neither above the limit (nor more read than tried), and what is left of it."""
    tried, read = F.count_if(F.col("tried")).cast("long"), F.count_if(F.col("read")).cast("long")
    g = pages.groupBy("company_id").agg(tried.alias("t"), read.alias("r"))
    tried = F.least(F.col("t"), F.lit(most))
    return g.select("company_id", tried.alias("attempted"), F.least("r", tried).alias("scraped"), F.greatest(F.lit(0), most - F.col("t")).alias("remaining"))


def merged_affinities(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, affinity``: the tags of all candidates folded under a key, each once, in the order in which they first occur.
    ``rows`` has candidate_id and affinity (a list), ``keys`` candidate_id, key and order."""
    each = rows.select("candidate_id", F.posexplode("affinity").alias("at", "tag")).join(keys, "candidate_id")
    first = each.groupBy("key", "tag").agg(F.min(F.struct("order", "at")).alias("first"))
    return first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))), lambda x: x["tag"]).alias("affinity"))
