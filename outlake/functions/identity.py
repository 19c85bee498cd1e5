"""Addresses, domains and names as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlake.functions.text import bound

# Words that carry no identity in a company's name.
NAME_STOP = "inc llc ltd corp corporation company co the group labs lab technologies technology tech systems solutions software ai io".split()
# Role and company inboxes.
GENERIC_LOCALS = (
    "founders founder ceo team hello hi hey careers jobs recruiting talent contact info press sales support admin office hr people general mail "
    "enquire enquiry inquiries inquiry help partners partnerships media marketing ops operations billing accounts account reception desk apply "
    "applications work join joinus join-us studio hello-world"
).split()
# Parts that are no outreach address, and image endings.
BAD_LOCALS = "noreply no-reply donotreply do-not-reply mailer-daemon postmaster abuse privacy legal unsubscribe spam".split()
BAD_DOMAINS = (
    "example.com sentry.io wixpress.com sentry.wixpress.com godaddy.com domain.com yourdomain.com email.com company.com sentry-next.wixpress.com mysite.com"
).split()
# Endings of image names.
IMAGE_ENDINGS = ".png .jpg .jpeg .gif .svg .webp".split()
# Suffixes that are no part of a name.
PERSON_SUFFIXES = "jr sr ii iii iv md phd mba esq".split()


def _words(ws: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in ws])


def normal_email(email: Column) -> Column:
    return F.lower(F.trim(F.coalesce(email, F.lit(""))))


def email_local(email: Column) -> Column:
    return F.substring_index(normal_email(email), "@", 1)


def email_domain(email: Column) -> Column:
    return F.substring_index(normal_email(email), "@", -1)


def canonical_mailbox(email: Column) -> Column:
    """The mailbox that an address delivers to: tags go unless nothing is left, dots go at gmail.com only."""
    e = normal_email(email)
    local, domain = F.substring_index(e, "@", 1), F.regexp_replace(e, r"^[^@]*@", "")
    domain = F.when(domain == "googlemail.com", "gmail.com").otherwise(domain)
    head = F.substring_index(local, "+", 1)
    local = F.when(head != "", head).otherwise(local)
    local = F.when(domain == "gmail.com", F.replace(local, F.lit("."), F.lit(""))).otherwise(local)
    return F.when(F.contains(e, F.lit("@")), F.concat(local, F.lit("@"), domain)).otherwise(e)


def domain_chain(domain: Column) -> Column:
    """A domain and its parents down to two labels, most specific first; a single label is its own chain."""
    parts = F.filter(F.split(domain, r"\."), lambda x: x != "")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(F.size(parts) > 1, chain).when(domain != "", F.array(domain)).otherwise(F.array().cast("array<string>"))


def registered_domain(url_or_domain: Column) -> Column:
    """The last two labels, or three under second-level registries such as co.uk; null for an empty name."""
    s = F.lower(F.trim(F.coalesce(url_or_domain, F.lit(""))))
    s = F.when(F.contains(s, F.lit("//")), F.regexp_extract(s, r"//([^/?#]*)", 1)).otherwise(s)
    s = F.substring_index(F.substring_index(s, "@", -1), ":", 1)
    s = F.regexp_replace(s, r"^www\.", "")
    parts = F.filter(F.split(s, r"\."), lambda x: x != "")
    three = (F.size(parts) >= 3) & F.get(parts, F.size(parts) - 2).isin("co", "com", "org", "net", "ac", "gov") & (F.length(F.get(parts, F.size(parts) - 1)) == 2)
    last = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    return F.when(F.size(parts) < 2, F.nullif(s, F.lit(""))).when(three, last(3)).otherwise(last(2))


def company_name_key(name: Column) -> Column:
    tokens = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(*NAME_STOP))
    return F.nullif(F.array_join(tokens, ""), F.lit(""))


def is_generic_inbox(email: Column) -> Column:
    local = F.substring_index(email_local(email), "+", 1)
    parts = F.split(local, "[._+-]+")
    return local.isin(*GENERIC_LOCALS) | F.forall(parts, lambda p: p.isin(*GENERIC_LOCALS) | (F.length(p) <= 1))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """How compatibility decomposition without combining marks changes characters, as far as letters and digits of ASCII
    come of it: characters with one such letter or digit and what that is, then marks, which go; and those that give
    several characters."""
    one, plain, marks, several = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        whole = unicodedata.normalize("NFKD", c)
        if whole == c:
            continue
        kept = "".join(x for x in whole if not unicodedata.combining(x))
        if any(x.isascii() and (x.isalnum() or x == "'") for x in kept):
            if len(kept) == 1:
                one.append(c)
                plain.append(kept)
            else:
                several[c] = kept
    return "".join(one + marks), "".join(plain), several


def fold(text: Column) -> Column:
    """Letters without their accents, wide and other compatibility forms as plain ones, in any script; apostrophes dropped."""
    signs, plain, several = _folding()
    spread = F.str_to_map(F.lit("\n".join(f"{c}\t{x}" for c, x in several.items())), F.lit("\n"), F.lit("\t"))
    # few texts hold a ligature or the like: only those are taken apart
    rare = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in several) + "]"
    apart = lambda x: F.when(x.rlike(rare), F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(spread[c], c)), "")).otherwise(x)
    # texts of ASCII alone, as most are, need none of it
    folded = lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(apart(x), signs, plain)).otherwise(x)
    return F.translate(bound(text, folded), "'’", "")


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(fold(F.coalesce(name, F.lit("")))), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*PERSON_SUFFIXES))


def email_matches_tokens(email: Column, tokens: Column) -> Column:
    """Whether the local part is strong evidence for the name of these tokens, which are used often: see ``bound``."""

    def match(x: Column) -> Column:
        parts, compact = x["parts"], x["compact"]
        first, last = F.get(tokens, F.lit(0)), F.get(tokens, F.size(tokens) - 1)
        head, tail = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
        ends = ((head == first) & (tail == last)) | ((head == last) & (tail == first))
        within = F.array_contains(parts, first) & F.array_contains(parts, last) & head.isin(first, last) & tail.isin(first, last)
        joined = compact.isin(F.concat(first, last), F.concat(last, first), F.concat(F.substring(first, 1, 1), last))
        fits = F.when(F.size(tokens) >= 2, F.when(F.size(parts) >= 2, ends | within).otherwise(joined)).otherwise((F.size(parts) == 1) & (head == first))
        return (compact != "") & F.coalesce(fits, F.lit(False))

    def taken_apart(local: Column) -> Column:
        parts = F.filter(F.split(local, "[._+-]+"), lambda p: p != "")
        return F.struct(parts.alias("parts"), F.regexp_replace(local, "[^a-z0-9]", "").alias("compact"))

    local = F.lower(fold(F.substring_index(email_local(email), "+", 1)))
    blocked = (normal_email(email) == "") | is_generic_inbox(email) | (F.size(tokens) == 0)
    return F.when(blocked, False).otherwise(bound(bound(local, taken_apart), match))


def email_matches_person(email: Column, name: Column, name_from_email: Column | None = None) -> Column:
    """Whether the local part is strong evidence for the person's name."""
    match = bound(name_tokens(name), lambda tokens: email_matches_tokens(email, tokens))
    return match if name_from_email is None else F.when(F.coalesce(name_from_email, F.lit(False)), False).otherwise(match)


def address_kind(email: Column, name: Column, accepts: Column) -> Column:
    """unknown, generic, personal or named_unmatched, and whether the address is verified (acceptance must be true)."""
    e = normal_email(email)
    valid = e.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
    person = email_matches_person(email, name)
    kind = F.when(~valid, "unknown").when(is_generic_inbox(email), "generic").when(person, "personal").otherwise("named_unmatched")
    return F.struct(kind.alias("kind"), (valid & person & F.coalesce(accepts, F.lit(False))).alias("verified"))


def is_outreach_address(email: Column) -> Column:
    """An address that one may write to: no image name, no robot, no placeholder domain."""
    e = normal_email(email)
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    image = F.lit(False)
    for x in IMAGE_ENDINGS:
        image |= e.endswith(x)
    robot = F.contains(local, F.lit("noreply")) | F.contains(local, F.lit("no-reply")) | F.contains(local, F.lit("donotreply"))
    one = F.length(e) - F.length(F.replace(e, F.lit("@"), F.lit(""))) == 1
    return one & (local != "") & (domain != "") & ~image & ~local.isin(*BAD_LOCALS) & ~robot & ~domain.isin(*BAD_DOMAINS) & (F.length(e) <= 80)


# What the local part of an inbox says about whose it is.
ROLE_OF_INBOX = {
    "careers": "Careers inbox", "jobs": "Careers inbox", "recruiting": "Recruiting", "talent": "Recruiting", "founders": "Founders", "founder": "Founders", "ceo": "CEO",
    "hello": "General inbox", "hi": "General inbox", "hey": "General inbox", "contact": "General inbox", "info": "General inbox", "team": "Team inbox", "press": "Press",
    "sales": "Sales", "support": "Support",
}


def role_of_inbox(email: Column) -> Column:
    """What an address's local part says of its role, or null."""
    return F.create_map(*[F.lit(x) for pair in ROLE_OF_INBOX.items() for x in pair])[email_local(email)]


def name_from_local(email: Column) -> Column:
    """``jane.doe`` gives ``Jane Doe``: two or three alphabetic parts of an address that isn't generic."""
    parts = F.filter(F.split(email_local(email), "[._-]+"), lambda p: p != "")
    fine = F.size(parts).between(2, 3) & F.forall(parts, lambda p: p.rlike("^[a-z]{2,}$")) & ~is_generic_inbox(email)
    return F.when(fine, F.array_join(F.transform(parts, lambda p: F.initcap(p)), " "))
