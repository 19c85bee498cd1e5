"""Contacts and companies that come in: gates, lookups, conflicts, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outlake.functions import identity, people
from outlake.functions.text import AGGREGATORS
from outlake.operators.claims import greedy
from outlake.operators.suppression import match
from outlake.sources.store import written


def gate(rows: DataFrame, suppressions: DataFrame) -> DataFrame:
    """``contact_id, decision, warning``: the first rule that refuses a contact, or accept, accept_profile_only.

    ``rows`` has contact_id, person, address, profile and accepts; blank channels are missing ones.
    """
    email, url, name = F.trim(F.coalesce("address", F.lit(""))), F.trim(F.coalesce("profile", F.lit(""))), F.trim(F.coalesce("person", F.lit("")))
    blocked = match(rows, suppressions, "contact_id", "address").select("contact_id", F.lit(True).alias("__blocked"))
    at = rows.join(blocked, "contact_id", "left").withColumn("__blocked", F.coalesce("__blocked", F.lit(False)))
    at = at.withColumn("__fits", people.profile_matches_person(url, name)).withColumn("__generic", (email != "") & identity.is_generic_inbox(email))
    # a role inbox goes when the profile is surely the person's
    kept = F.when(F.col("__generic") & (url != "") & (name != "") & F.col("__fits"), "").otherwise(email)
    at = at.withColumn("__kept", kept)
    # a column of its own: what is used often is neither computed nor planned as often
    at = at.withColumn("__person", identity.email_matches_person(F.col("__kept"), name))
    person = F.col("__person")
    has_profile = (url != "") & F.col("__fits")
    decision = (
        F.when((email != "") & ~people.valid_address(email), "invalid_email")
        .when((email != "") & F.col("__blocked"), "suppressed")
        .when((url != "") & people.strict_profile(url).isNull(), "invalid_linkedin_url")
        .when(F.col("__kept").isNotNull() & F.col("__generic") & (F.col("__kept") != ""), "company_or_role_inbox")
        .when((url != "") & (name == ""), "linkedin_needs_name")
        .when((F.col("__kept") == "") & ~has_profile, "no_usable_contact_method")
        .when((F.col("__kept") != "") & (name != "") & ~person & ~has_profile, "email_does_not_match_name")
        .when((F.col("__kept") != "") & (name == ""), "name_required_for_email")
        .when((F.col("__kept") == "") | ~person, "accept_profile_only")
        .otherwise("accept")
    )
    warning = F.when((url != "") & (name != "") & ~F.col("__fits"), "linkedin_does_not_match_name")
    at = at.withColumn("__warning", warning).select("contact_id", decision.alias("decision"), "__warning")
    return at.select("contact_id", "decision", F.when(F.col("decision").startswith("accept"), F.col("__warning")).alias("warning"))


def import_counters(decided: DataFrame, samples: int = 5) -> DataFrame:
    """Per decision its count and the first ids of refused rows."""
    decided = written(decided.select("contact_id", "decision", "warning"))
    n = F.row_number().over(W.partitionBy("decision").orderBy("contact_id"))
    few = decided.withColumn("n", n).where((F.col("n") <= samples) & ~F.col("decision").startswith("accept"))
    few = few.groupBy("decision").agg(F.array_join(F.array_sort(F.collect_list("contact_id")), ",").alias("samples"))
    counts = decided.groupBy("decision").agg(F.count("*").alias("n"), F.count("warning").alias("warnings"))
    return counts.join(few, "decision", "left").withColumn("samples", F.coalesce("samples", F.lit("")))


def existing(candidates: DataFrame, contacts: DataFrame) -> DataFrame:
    """Who already holds a candidate's address, else its profile: ``candidate_id, contact_id, company_id`` (nulls if
    nobody does).  ``contacts`` has contact_id, company_id, address, profile; the smallest id answers."""
    def held(key: Column, name: str) -> DataFrame:
        rows = contacts.select(key.alias(name), F.struct("contact_id", "company_id").alias(f"by_{name}")).where(F.coalesce(name, F.lit("")) != "")
        return rows.groupBy(name).agg(F.min(f"by_{name}").alias(f"by_{name}"))

    email, url = identity.normal_email(F.col("address")), people.stored_profile(F.col("profile"))
    at = candidates.withColumn("e", email).withColumn("u", url).join(held(email, "e"), "e", "left").join(held(url, "u"), "u", "left")
    found = F.coalesce("by_e", "by_u")
    return at.select("candidate_id", found["contact_id"].alias("contact_id"), found["company_id"].alias("company_id"))


def inserted(candidates: DataFrame, contacts: DataFrame) -> DataFrame:
    """``candidate_id, contact_id, inserted``: a candidate whose identifier a stored row has gives that row.  ``claims.claimed``
    also sees what earlier candidates of the batch take."""
    return existing(candidates, contacts).select("candidate_id", "contact_id", F.col("contact_id").isNull().alias("inserted"))


def conflicts(candidates: DataFrame, contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """Candidates whose identifier belongs to another company, with the note that says so.  ``candidates`` has the
    company_id and company that want them."""
    found = existing(candidates, contacts).where("contact_id is not null").withColumnRenamed("company_id", "owner_id")
    owner = companies.select(F.col("company_id").alias("owner_id"), F.col("name").alias("owner"))
    at = candidates.join(found.join(owner, "owner_id", "left"), "candidate_id").where("owner_id is null or owner_id <> company_id")
    label = F.coalesce(F.nullif(F.trim("address"), F.lit("")), F.col("profile"))
    note = F.concat(label, F.lit(" already belongs to "), F.coalesce("owner", F.lit("another company")), F.lit(" — not reassigned to "), F.coalesce("company", F.lit("this company")))
    return at.select("candidate_id", "contact_id", note.alias("note"))


def usable_channels(known: Column, address: Column, profile: Column, name: Column) -> Column:
    """A candidate's channels without unverified ones: ``email`` and ``profile``, '' for what goes."""
    unsure = (known["kind"] == "generic") | ((name != "") & ~known["person_match"] & ~known["email_verified"])
    email = F.when((F.trim(F.coalesce(address, F.lit(""))) == "") | unsure, "").otherwise(F.trim(address))
    return F.struct(email.alias("email"), F.when(known["profile_verified"], profile).otherwise("").alias("profile"))


def attached(candidates: DataFrame, contacts: DataFrame) -> DataFrame:
    """What attaching verified candidates to their company does: ``candidate_id, action`` (attach, enrich, conflict or
    nothing) and which channels land.  ``candidates`` has candidate_id, company_id, address, profile, person and known."""
    ok = usable_channels(F.col("known"), F.col("address"), F.col("profile"), F.col("person"))
    c = candidates.withColumn("ok", ok).select("candidate_id", F.col("company_id").alias("wants"), F.col("ok.email").alias("address"), F.col("ok.profile").alias("profile"))
    at = c.join(existing(c, contacts), "candidate_id")
    none = (F.col("address") == "") & (F.coalesce("profile", F.lit("")) == "")
    action = F.when(none, "nothing").when(F.col("contact_id").isNull(), "attach").when(F.col("company_id").eqNullSafe(F.col("wants")), "enrich").otherwise("conflict")
    lands = action == "attach"
    return at.select("candidate_id", action.alias("action"), (lands & (F.col("address") != "")).alias("email_lands"), (lands & (F.coalesce("profile", F.lit("")) != "")).alias("profile_lands"))


def top_people(rows: DataFrame, most: int) -> DataFrame:
    """The best verified people of each company: ``company_id, place, contact_id``.  ``rows`` has known, on_domain,
    seniority_rank and the person's columns."""
    k = F.col("known")
    real = (F.col("person") != "") & ~F.col("name_from_email") & (k["person_verified"] | k["profile_verified"] | (k["person_match"] & (k["kind"] == "personal")))
    no = lambda c: F.when(c, 0).otherwise(1)
    channel = F.lower(F.coalesce(F.nullif(F.trim("address"), F.lit("")), F.col("profile"), F.lit("")))
    key = [no(k["person_verified"]), no(k["email_verified"]), no(k["profile_verified"]), no(k["kind"] == "personal"), F.coalesce("seniority_rank", F.lit(20)), no(F.col("on_domain")), channel, F.col("contact_id")]
    place = F.row_number().over(W.partitionBy("company_id").orderBy(*key)).cast("long")
    return rows.where(real).withColumn("place", place).where(F.col("place") <= most).select("company_id", "place", "contact_id")


def extraction_order(rows: DataFrame) -> DataFrame:
    """Place of each extracted person of a company: school matches first, then by rank, on the company's domain, with a
    name, no role inbox, then by channel (O8)."""
    no = lambda c: F.when(c, 0).otherwise(1)
    channel = F.lower(F.coalesce(F.nullif(F.trim("address"), F.lit("")), F.col("profile"), F.lit("")))
    generic = F.when((F.trim("address") != "") & identity.is_generic_inbox(F.col("address")), 1).otherwise(0)
    key = [no(F.col("school_match")), F.coalesce("seniority_rank", F.lit(20)), no(F.col("on_domain")), no(F.col("person") != ""), generic, channel, F.col("contact_id")]
    return rows.select("company_id", "contact_id", F.row_number().over(W.partitionBy("company_id").orderBy(*key)).cast("long").alias("place"))


def best_per_email(rows: DataFrame) -> DataFrame:
    """The best candidate of each address: a match of school, then the higher rank, then one with a name, then the
    earlier one.  ``rows`` has candidate_id (the order), address, school_match, seniority_rank, person."""
    email = identity.normal_email(F.col("address"))
    order = F.struct(F.when(F.col("school_match"), 0).otherwise(1), F.coalesce("seniority_rank", F.lit(20)), F.when(F.col("person") != "", 0).otherwise(1), F.col("candidate_id"))
    return rows.where(email != "").groupBy(email.alias("email")).agg(F.min_by("candidate_id", order).alias("candidate_id"))


def persistable(rows: DataFrame, least: int, most_matched: int = 20, most_others: int = 12) -> DataFrame:
    """Who is kept of each company: matches up to a cap, others up to ``least`` people in all, then so many more others.
    ``rows`` has company_id, contact_id, matched, score and seniority_rank."""
    order = W.partitionBy("company_id", "matched").orderBy(F.desc("score"), F.coalesce("seniority_rank", F.lit(20)), "contact_id")
    n = rows.withColumn("n", F.row_number().over(order).cast("long"))
    matches = F.least(F.lit(most_matched), F.sum(F.when(F.col("matched"), 1).otherwise(0)).over(W.partitionBy("company_id"))).cast("long")
    n = n.withColumn("limit", F.when(F.col("matched"), most_matched).otherwise(F.greatest(F.lit(0), least - matches) + most_others))
    return n.where("n <= limit").select("company_id", "contact_id", "matched", F.col("n").alias("place"))


def company_lookup(wanted: DataFrame, companies: DataFrame) -> DataFrame:
    """One row per wanted company: the id that its name, else its name key, else its domain names, and which did.
    ``wanted`` has wanted_id, name and domain; of several companies the oldest answers."""
    def first(key: Column, alias: str) -> DataFrame:
        rows = companies.select(key.alias(alias), F.struct("created_at", "company_id").alias("x")).where(F.coalesce(alias, F.lit("")) != "")
        return rows.groupBy(alias).agg(F.min("x")["company_id"].alias(f"by_{alias}"))

    keys = {"n": F.lower(F.trim("name")), "k": identity.company_name_key(F.col("name")), "d": F.lower(F.trim("domain"))}
    at = wanted.withColumns(keys)
    for alias, key in keys.items():
        at = at.join(first(key, alias), alias, "left")
    how = F.when(F.col("by_n").isNotNull(), "name").when(F.col("by_k").isNotNull(), "name_key").when(F.col("by_d").isNotNull(), "domain")
    return at.select("wanted_id", F.coalesce("by_n", "by_k", "by_d").alias("company_id"), how.alias("found_by"))


def insert_or_match(wanted: DataFrame, companies: DataFrame) -> DataFrame:
    """What inserting a company does: ``wanted_id, action, company_id, name_key``.

    A known domain is a match.  An equal name is one only if both have the same domain or neither has one.  An equal name
    key is one for an equal domain, and claims a row without domain if the names are equal; else the key gets a suffix.
    """
    def first(key: Column, alias: str) -> DataFrame:
        x = F.struct("created_at", "company_id", F.nullif(F.lower("domain"), F.lit("")).alias("domain"), F.lower(F.trim("name")).alias("name"))
        rows = companies.select(key.alias(alias), x.alias("x")).where(F.coalesce(alias, F.lit("")) != "")
        return rows.groupBy(alias).agg(F.min("x").alias(f"by_{alias}"))

    domain = F.nullif(F.lower(F.trim("domain")), F.lit(""))
    keys = {"d": domain, "n": F.lower(F.trim("name")), "k": identity.company_name_key(F.col("name"))}
    at = wanted.withColumns(keys)
    for alias, key in {"d": F.lower(F.trim("domain")), "n": keys["n"], "k": keys["k"]}.items():
        at = at.join(first(key, alias), alias, "left")
    same_name = F.col("by_n").isNotNull() & F.col("by_n.domain").eqNullSafe(F.col("d"))
    claims = F.col("by_k").isNotNull() & F.col("d").isNotNull() & F.col("by_k.domain").isNull() & (F.col("by_k.name") == F.col("n"))
    action = F.when(F.col("by_d").isNotNull(), "match_domain").when(same_name, "match_name").when(claims, "claim").otherwise("insert")
    target = F.when(action == "match_domain", F.col("by_d.company_id")).when(action == "match_name", F.col("by_n.company_id")).when(action == "claim", F.col("by_k.company_id"))
    suffix = F.coalesce(F.substring_index("d", ".", 1), F.col("wanted_id").cast("string"))
    key = F.when(F.col("by_k").isNotNull() & (action == "insert"), F.concat("k", F.lit(":"), suffix)).otherwise(F.col("k"))
    return at.select("wanted_id", action.alias("action"), target.alias("company_id"), F.when(action.isin("insert", "claim"), key).alias("name_key"))


def union_of_sources(first: DataFrame, second: DataFrame, most: int) -> DataFrame:
    """Companies from two sources, the first source first: each name and each domain once, no aggregators, no long names,
    ``most`` a query.  Both have query_id, place, name and website.

    A row goes if an earlier row that stays has its name or its domain (``claims.greedy``).
    """
    rows = first.withColumn("source", F.lit(1)).unionByName(second.withColumn("source", F.lit(2)))
    name = F.trim(F.regexp_replace(F.trim(F.coalesce("name", F.lit(""))), r"^\.+|\.+$", ""))
    rows = rows.withColumn("name", name).withColumn("domain", identity.registered_domain(F.nullif(F.col("website"), F.lit(""))))
    rows = rows.where((F.length("name").between(1, 80)) & ~F.coalesce(F.col("domain").isin(*AGGREGATORS), F.lit(False)))
    # equal rows of a place can't be told apart: the first of their names and domains counts
    rows = rows.withColumn("at", F.struct("query_id", "source", "place", "name", F.coalesce("domain", F.lit("")).alias("d"))).dropDuplicates(["at"])
    rows = rows.withColumn("low", F.struct("query_id", F.lower("name"))).withColumn("site", F.when(F.col("domain").isNotNull(), F.struct("query_id", "domain")))
    kept, _ = greedy(rows, ["low", "site"], "at")
    rows = kept.where("stays").select("at.*")
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("source", "place", "name", "d")).cast("long")).where(F.col("n") <= most)
    return rows.select("query_id", F.col("n").alias("place"), "name", F.nullif("d", F.lit("")).alias("domain"))


def candidate_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``, the identity under which ``merged_candidates`` folds them, and ``order`` within it."""
    url, email = people.stored_profile(F.col("profile")), identity.normal_email(F.col("address"))
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    alone = F.concat_ws("|", F.concat(F.lit("nm:"), low("person")), low("title"), low("source"))
    key = F.when(url.isNotNull(), F.concat(F.lit("li:"), url)).when(email != "", F.concat(F.lit("em:"), email)).when(low("person") != "", alone).otherwise(F.concat(F.lit("id:"), F.col("candidate_id").cast("string")))
    at = rows.withColumn("key", key).withColumn("low", low("person")).withColumn("strong", url.isNotNull() | (email != ""))
    strong = at.where("strong and low <> ''").groupBy("low").agg(F.min_by("key", "candidate_id").alias("into"))
    at = at.join(strong, "low", "left").withColumn("key", F.when(~F.col("strong") & F.col("into").isNotNull(), F.col("into")).otherwise(F.col("key")))
    # channels of the row itself before those of weaker rows
    return at.withColumn("order", F.struct(F.when(F.col("strong"), 0).otherwise(1), F.col("candidate_id")))


def merged_candidates(rows: DataFrame) -> DataFrame:
    """Candidates folded by identity (profile, else address, else name, title and source): missing fields come from later
    rows.  Rows with a name alone fold into the first row of that name that has a channel.

    ``rows`` has candidate_id (the order), person, address, profile, title, source.
    """
    at, order = candidate_keys(rows), F.col("order")
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", order)), F.lit("")).alias(c)
    return at.groupBy("key").agg(F.min("candidate_id").alias("candidate_id"), *[first(c) for c in ("person", "address", "profile", "title")])
