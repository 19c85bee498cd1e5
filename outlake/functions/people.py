"""People and their channels as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from outlake.functions import identity as I  # noqa: E741
from outlake.functions.text import bound

# Locals of roles and robots besides the generic inboxes.
EXTRA_ROLE_LOCALS = (
    "legal privacy compliance security abuse webmaster hiring internships internship noreply no-reply donotreply do-not-reply newsletter "
    "newsletters notifications notify updates feedback bugs postmaster mailer-daemon subscribe unsubscribe invoices invoice payments orders "
    "shop service services customerservice customersupport care auto-reply autoreply bounces dpo helpdesk it reply"
).split()
# Locals that outreach prefers among generic ones, in this order.
LOCAL_PREFERENCE = "founders founder ceo team hello hi hey careers jobs recruiting talent contact info press sales support admin office".split()
# Titles with their label and rank, the first that occurs counts; and locals that stand for a role.
ROLES = (
    ("CEO", r"\b(?:chief executive officer|ceo)\b", 0), ("Founder", r"\b(?:co-?founder|founder)\b", 1), ("President", r"\bpresident\b", 2),
    ("CTO", r"\b(?:chief technology officer|cto)\b", 3), ("COO", r"\b(?:chief operating officer|coo)\b", 3), ("CFO", r"\b(?:chief financial officer|cfo)\b", 3),
    ("Chief", r"\bchief [a-z -]+ officer\b", 3), ("Partner", r"\b(?:managing )?partner\b", 4), ("VP", r"\b(?:vice president|vp)\b", 5), ("Head", r"\bhead of\b", 6),
    ("Director", r"\bdirector\b", 7), ("Hiring manager", r"\bhiring manager\b", 7), ("Engineering manager", r"\bengineering manager\b", 7),
    ("Recruiting", r"\b(?:recruiter|recruiting|talent acquisition|talent partner)\b", 8),
)
ROLE_LOCALS = {"ceo": ("CEO", 0), "founder": ("Founder", 1), "founders": ("Founders", 1), "careers": ("Careers inbox", 10), "jobs": ("Careers inbox", 10), "recruiting": ("Recruiting", 8), "talent": ("Recruiting", 8)}
NO_RANK = 20
# How names and titles stand side by side.
TITLE_WORDS = (
    r"(?:CEO|Chief Executive Officer|Founder|Co-Founder|President|CTO|Chief Technology Officer|COO|CFO|Vice President|VP|Head of [A-Za-z &-]+|Director(?: of [A-Za-z &-]+)?)"
)
FULL_NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z.'-]+){1,3})"
NAME_THEN_TITLE = rf"{FULL_NAME}\s*(?:,|–|—|-|\|)\s*{TITLE_WORDS}"
TITLE_THEN_NAME = rf"{TITLE_WORDS}\s*(?:,|:|–|—|-|\|)?\s*{FULL_NAME}"
# Labels of address kinds.
KIND_LABELS = {"personal": "Personal address", "named_unmatched": "Named, unmatched", "generic": "Role inbox", "none": "No address", "unknown": "Unknown"}
# Forms of addresses and profiles, of what looks like a hash in a slug, of companies, and the least similarity of a name and a domain.
ADDRESS = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)+$"
PROFILE = r"(?i)^https://(?:www\.)?linkedin\.com(/in/[^?#]*)"
ANY_PROFILE = r"(?i)^[a-z]+://(?:www\.)?linkedin\.com/in/([^/?#]+)"
HASH = "^[a-f0-9]{5,}$"
COMPANY_FORMS = r"\b(incorporated|inc|llc|ltd|corp|corporation|co|company)\b\.?"
SIMILAR = 0.85


def is_role_local(email: Column) -> Column:
    """Whether the local part is made of role words: as a whole, or in all its parts."""
    local = F.substring_index(I.email_local(email), "+", 1)
    parts = F.filter(F.split(local, "[._+-]+"), lambda p: p != "")
    known = [*EXTRA_ROLE_LOCALS, *I.GENERIC_LOCALS]
    return (local != "") & (local.isin(*EXTRA_ROLE_LOCALS) | ((F.size(parts) > 0) & F.forall(parts, lambda p: p.isin(*known) | (F.length(p) <= 1))))


def valid_address(text: Column) -> Column:
    return F.trim(text).rlike(ADDRESS)


def valid_url(text: Column) -> Column:
    """http or https, with a host, on a usual port."""
    t = F.trim(text)
    port = F.regexp_extract(t, r"^[a-zA-Z]+://[^/?#]*?:([0-9]+)(?:[/?#]|$)", 1)
    return t.rlike(r"^(?i)https?://[^/?#:\s]+(?::[0-9]*)?(?:[/?#]|$)") & port.isin("", "80", "443")


def stored_profile(url: Column) -> Column:
    """A profile's address as it is stored: http and www forms are one; null if blank."""
    value = F.regexp_replace(F.trim(url), "/+$", "")
    return F.nullif(F.regexp_replace(value, r"(?i)^https?://(www\.)?linkedin\.com", "https://www.linkedin.com"), F.lit(""))


def strict_profile(url: Column) -> Column:
    """A member's public profile, or null for anything else."""
    path = F.regexp_extract(F.trim(url), PROFILE, 1)
    return F.when(path != "", F.concat(F.lit("https://www.linkedin.com"), F.regexp_replace(path, "/+$", "")))


def profiles_in(text: Column) -> Column:
    """Profiles that a text names, each once, in order."""
    slugs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)https?://(?:www\.)?linkedin\.com/in/([A-Za-z0-9\-_%]{2,})"), F.lit(1))
    lower = F.array_distinct(F.transform(slugs, lambda s: F.lower(s)))
    return F.transform(lower, lambda s: F.concat(F.lit("https://www.linkedin.com/in/"), F.get(F.filter(slugs, lambda x: F.lower(x) == s), F.lit(0))))


def profile_slug(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), ANY_PROFILE, 1)), F.lit(""))


def slug_parts(url: Column) -> Column:
    """Parts of a profile's slug, in plain letters; null without a slug."""
    return F.filter(F.split(F.lower(I.fold(profile_slug(url))), "[-_]+"), lambda p: p != "")


def _kept(parts: Column, tokens: Column) -> Column:
    """Parts of a slug without numbers and what looks like a hash, unless it is a name; if nothing is left, all of them."""
    kept = F.filter(parts, lambda p: ~((p.rlike(HASH) & ~F.array_contains(tokens, p)) | p.rlike("^[0-9]{2,}$")))
    return F.when(F.size(kept) > 0, kept).otherwise(parts)


def slug_keys(parts: Column) -> Column:
    """What a slug of these parts has in common with each name that it fits (see ``name_keys``): its parts, and all that
    count as one."""
    whole = F.array_join(_kept(parts, F.array().cast("array<string>")), "")
    return F.array_distinct(F.array_append(parts, whole))


def name_keys(tokens: Column) -> Column:
    """What a name has in common with each slug that it fits: its first word, its words as one, and words like a hash,
    as only with them other parts count."""
    first, last = F.get(tokens, F.lit(0)), F.get(tokens, F.size(tokens) - 1)
    joined = F.array(first, F.concat(first, last), F.concat(last, first), F.concat(F.substring(first, 1, 1), last))
    return F.array_distinct(F.concat(joined, F.filter(tokens, lambda t: t.rlike(HASH))))


def parts_match_tokens(parts: Column, tokens: Column) -> Column:
    """Whether a slug of these parts fits the name of these tokens: see ``profile_matches_person``."""

    def match(kept: Column) -> Column:
        first, last = F.get(tokens, F.lit(0)), F.get(tokens, F.size(tokens) - 1)
        compact = F.array_join(kept, "")
        two = (F.array_contains(kept, first) & F.array_contains(kept, last)) | compact.isin(F.concat(first, last), F.concat(last, first), F.concat(F.substring(first, 1, 1), last))
        fits = F.when(F.size(tokens) >= 2, two).otherwise(F.array_contains(kept, first) & (compact == first))
        return parts.isNotNull() & (F.size(tokens) > 0) & F.coalesce(fits, F.lit(False))

    return bound(_kept(parts, tokens), match)


def profile_matches_person(url: Column, name: Column) -> Column:
    """First and last name among the slug's parts, or as one; a single name must be the whole slug."""
    return bound(F.struct(slug_parts(url).alias("parts"), I.name_tokens(name).alias("tokens")), lambda x: parts_match_tokens(x["parts"], x["tokens"]))


def annotated(email: Column, name: Column, profile: Column, accepts: Column, name_from_email: Column, on_domain: Column) -> Column:
    """What is known about a person's channels: kind, person_match, email_verified, profile_verified, person_verified."""
    blank = I.normal_email(email) == ""
    kind = F.when(blank, "none").otherwise(I.address_kind(email, name, accepts)["kind"])
    fits = ~blank & I.email_matches_person(email, name, name_from_email)
    sure = fits & F.coalesce(accepts, F.lit(False))
    slug = profile_matches_person(profile, name)
    person = (F.trim(F.coalesce(name, F.lit(""))) != "") & ~name_from_email & (sure | slug | (fits & on_domain & F.coalesce(accepts, F.lit(False))))
    return F.struct(kind.alias("kind"), fits.alias("person_match"), sure.alias("email_verified"), slug.alias("profile_verified"), person.alias("person_verified"))


def role_and_rank(context: Column, local: Column) -> Column:
    """``label`` and ``rank`` of the first title in the list that occurs; else of the local part; else null and 20."""
    out = F
    for label, pattern, rank in ROLES:
        out = out.when(F.coalesce(context, F.lit("")).rlike("(?i)" + pattern), F.struct(F.lit(label).alias("label"), F.lit(rank).alias("rank")))
    for word, (label, rank) in ROLE_LOCALS.items():
        out = out.when(F.lower(local) == word, F.struct(F.lit(label).alias("label"), F.lit(rank).alias("rank")))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("label"), F.lit(NO_RANK).alias("rank")))


def name_from_context(context: Column, local: Column) -> Column:
    """A person's name beside a title, else from the local part; '' if neither gives one."""
    text = F.coalesce(context, F.lit(""))
    parts = F.filter(F.split(local, "[._-]"), lambda p: p.rlike(r"^\p{L}{2,}$"))
    from_local = F.when(F.size(parts) >= 2, F.array_join(F.transform(F.slice(parts, 1, 3), lambda p: F.initcap(p)), " ")).when(
        (F.size(parts) == 1) & ~F.lower(local).isin(*LOCAL_PREFERENCE, *I.BAD_LOCALS), F.initcap(F.get(parts, F.lit(0)))
    )
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (NAME_THEN_TITLE, TITLE_THEN_NAME)]
    return F.coalesce(*found, from_local, F.lit(""))


def address_patterns(name: Column, domain: Column) -> Column:
    """Six usual addresses of a person at a domain, without generic ones; a hint, never an address to write to."""
    d = F.regexp_replace(F.lower(F.trim(F.coalesce(domain, F.lit("")))), "^@+", "")

    def shapes(t: Column) -> Column:
        first, last = F.get(t, F.lit(0)), F.get(t, F.size(t) - 1)
        joined = [(first, ".", last), (first, "", last), (F.substring(first, 1, 1), "", last), (first, "_", last), (first, "-", last), (last, ".", first)]
        made = F.array_distinct(F.array(*[F.concat(a, F.lit(sep), b, F.lit("@"), d) for a, sep, b in joined]))
        fine = lambda e: ~I.is_generic_inbox(e) & I.email_matches_tokens(e, t)
        return F.when((F.size(t) >= 2) & d.contains("."), F.filter(made, fine)).otherwise(F.array().cast("array<string>"))

    return bound(I.name_tokens(name), shapes)


@F.pandas_udf(BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether one of the strings in ``a`` (blank-separated) is as good as ``b``, by matching blocks."""
    from difflib import SequenceMatcher

    return pd.Series([any(SequenceMatcher(None, t, y).ratio() >= SIMILAR for t in (x or "").split()) for x, y in zip(a, b, strict=True)])


def domain_matches_name(company: Column, domain: Column) -> Column:
    """Whether a domain may well be a company's own.  The fuzzy comparison only sees what the exact rules reject."""
    stem = F.regexp_replace(F.lower(F.substring_index(F.coalesce(domain, F.lit("")), ".", 1)), "[^a-z0-9]", "")
    tokens = F.filter(F.split(F.lower(F.coalesce(company, F.lit(""))), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*I.NAME_STOP))
    joined = F.array_join(tokens, "")
    exact = (joined == stem) | stem.contains(joined) | joined.contains(stem) | F.exists(tokens, lambda t: (t == stem) | ((F.length(t) >= 5) & (stem.contains(t) | t.contains(stem))))
    usable = (stem != "") & (joined != "")
    long = F.array_join(F.filter(F.array_append(tokens, joined), lambda t: F.length(t) >= 5), " ")
    fuzzy = _similar(F.when(usable & ~exact, long).otherwise(""), stem)
    return usable & (exact | fuzzy)


def mentions_company(company: Column, text: Column) -> Column:
    """Strict: the company's full phrase, all of two or more words, or one word of six letters or more."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(company, F.lit(""))), COMPANY_FORMS, " "), "[^a-z0-9]+", " "))
    blob = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    has = lambda w: blob.contains(F.concat(F.lit(" "), w, F.lit(" ")))
    words = F.filter(F.split(cleaned, " "), lambda w: F.length(w) >= 3)
    # one blank for what may stand between the words of a phrase, a mark for every other sign
    spaced = F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[\s\-_,./]+", " ")
    phrase = F.regexp_replace(spaced, "[^a-z0-9 ]", " \u0001 ").contains(F.concat(F.lit(" "), cleaned, F.lit(" ")))
    return (F.length(cleaned) >= 3) & (phrase | ((F.size(words) >= 2) & F.forall(words, has)) | ((F.size(words) == 1) & (F.length(F.get(words, F.lit(0))) >= 6) & has(F.get(words, F.lit(0)))))


def page_mentions_company(company: Column, text: Column) -> Column:
    """On a page: the name's words joined, anywhere in the squeezed text, or every word."""
    tokens = F.filter(F.split(F.lower(F.coalesce(company, F.lit(""))), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*I.NAME_STOP))
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    spaced = F.concat(F.lit(" "), words, F.lit(" "))
    every = F.forall(tokens, lambda t: spaced.contains(F.concat(F.lit(" "), t, F.lit(" "))))
    return (F.size(tokens) > 0) & (F.replace(words, F.lit(" "), F.lit("")).contains(F.array_join(tokens, "")) | every)


def criteria_terms(criteria: Column, most: int = 12) -> Column:
    """Terms of free text: split at signs and ``and``, each once whatever its case, ``most`` of them."""
    parts = F.split(F.coalesce(criteria, F.lit("")), r"(?i)[;\n|/]+|,|\band\b")
    clean = F.filter(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r"^[ .]+|[ .]+$", "")), lambda p: F.length(p) >= 2)
    lowered = F.transform(clean, lambda p: F.lower(p))
    return F.slice(F.filter(clean, lambda p, i: F.array_position(lowered, F.lower(p)) == i + 1), 1, most)


def noted_terms(notes: Column) -> Column:
    """Criteria terms that research stamped on a contact's notes."""
    text = F.trim(F.regexp_replace(F.coalesce(notes, F.lit("")), r"\s+", " "))
    found = F.regexp_extract(text, r"(?i)criteria match:\s*([^;]+)", 1)
    return F.filter(F.transform(F.split(found, ","), lambda p: F.trim(p)), lambda p: p != "")


def is_noted_match(notes: Column) -> Column:
    """A bare mark counts as well."""
    return F.coalesce(notes, F.lit("")).rlike(r"(?i)\bcriteria\s+match\b")
