"""Registered queries: address and name functions, suppression, duplicates and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlake.functions import identity
from outlake.operators import duplicates, filters, suppression, windows
from outlake.plans.views import AS_OF, load


def _contacts(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "contacts")


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _kept(s: SparkSession, d: str) -> DataFrame:
    """Duplicates within a company by address: who is kept."""
    best = [F.when(F.col("person_verified"), 0).otherwise(1)]
    return duplicates.keepers(_contacts(s, d), "contact_id", [F.col("company_id"), F.nullif(F.lower("email"), F.lit(""))], best)


def _kept_across(s: SparkSession, d: str) -> DataFrame:
    best = [F.when(F.col("person_verified"), 0).otherwise(1)]
    return duplicates.keepers(_contacts(s, d), "contact_id", [F.nullif(F.lower("email"), F.lit(""))], best)


def _person(s: SparkSession, d: str) -> DataFrame:
    """Contacts with names that their addresses may or may not match."""
    name = F.concat(F.lit("Jane P"), (F.col("contact_id") % 500).cast("string"), F.when(F.col("contact_id") % 5 == 0, " Jr.").otherwise(""))
    return _contacts(s, d).withColumn("person", F.when(F.col("contact_id") % 4 == 0, F.concat(F.lit("P"), (F.col("contact_id") % 500).cast("string"))).otherwise(name))


_CANON = """regexp_replace(case when position('@' in e) = 0 then e else
 concat(case when d = 'gmail.com' then replace(case when head <> '' then head else l end, '.', '') else case when head <> '' then head else l end end, '@', d) end, '$', '')"""
_MATCH = """box as (select contact_id, lower(trim(email)) as e, split_part(lower(trim(email)), '@', 1) as l, split_part(split_part(lower(trim(email)), '@', 1), '+', 1) as head,
 replace(split_part(lower(trim(email)), '@', 2), 'googlemail.com', 'gmail.com') as d, split_part(lower(trim(email)), '@', 2) as raw from contacts where trim(coalesce(email, '')) <> ''),
hits as (select contact_id, s.*, -1 as depth from box join suppressions s on s.kind = 'address' and concat(case when head <> '' then head else l end, '@', d)
  = concat(split_part(split_part(lower(s.value), '@', 1), '+', 1), '@', split_part(lower(s.value), '@', 2))
 union all select contact_id, s.*, i from (select contact_id, unnest(range(0, len(string_split(raw, '.')) - 1)) as i, string_split(raw, '.') as parts from box) c
 join suppressions s on s.kind = 'domain' and array_to_string(parts[i + 1:], '.') = lower(s.value)),
picked as (select *, row_number() over (partition by contact_id order by depth, created_at desc, value, suppression_id) as n from hits)"""
_KEEP = """dup as (select contact_id, company_id, lower(email) as k, person_verified from contacts where coalesce(email, '') <> '' and company_id is not null),
keep as (select contact_id, first_value(contact_id) over (partition by company_id, k order by case when person_verified then 0 else 1 end, contact_id) as keep_id,
 count(*) over (partition by company_id, k) as n from dup)"""
_KEEP_ACROSS = """keep as (select contact_id, first_value(contact_id) over (partition by lower(email) order by case when person_verified then 0 else 1 end, contact_id) as keep_id,
 count(*) over (partition by lower(email)) as n from contacts where coalesce(email, '') <> '')"""
_KEY = f"nullif(array_to_string(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '' and x not in ({_quoted(identity.NAME_STOP)})), ''), '')"
_GENERIC = f"""(split_part(split_part(lower(trim(email)), '@', 1), '+', 1) in ({_quoted(identity.GENERIC_LOCALS)}) or
 len(list_filter(regexp_split_to_array(split_part(split_part(lower(trim(email)), '@', 1), '+', 1), '[._+-]+'), lambda p: not (p in ({_quoted(identity.GENERIC_LOCALS)}) or length(p) <= 1))) = 0)"""

ENTITIES = {
    "f1_f2_canonical_mailbox": (
        lambda s, d: _contacts(s, d).select("contact_id", identity.normal_email(F.col("email")).alias("email"), identity.email_domain(F.col("email")).alias("domain"), identity.canonical_mailbox(F.col("email")).alias("mailbox")),
        """select contact_id, lower(trim(email)) as email, regexp_replace(lower(trim(email)), '^.*@', '') as domain, case when email like '%@%' then concat(split_part(split_part(lower(trim(email)), '@', 1), '+', 1), '@', split_part(lower(trim(email)), '@', 2)) else lower(trim(email)) end as mailbox from contacts""",
    ),
    "f4_domain_chain": (
        lambda s, d: _contacts(s, d).where("email <> ''").select("contact_id", F.posexplode(identity.domain_chain(identity.email_domain(F.col("email")))).alias("depth", "domain")),
        """select contact_id, cast(i as integer) as depth, array_to_string(p[i + 1:], '.') as domain from (select contact_id, p, unnest(range(0, len(p) - 1)) as i from
 (select contact_id, string_split(split_part(lower(trim(email)), '@', 2), '.') as p from contacts where email <> ''))""",
    ),
    "f5_f28_registered_domain": (
        lambda s, d: load(s, d, "pages").select("page_id", identity.registered_domain(F.col("url")).alias("domain")),
        """select page_id, array_to_string(p[-2:], '.') as domain from (select page_id, string_split(regexp_replace(regexp_extract(lower(trim(url)), '//([^/?#]*)', 1), '^www\\.', ''), '.') as p from pages)""",
    ),
    "f6_u5_company_name_key": (
        lambda s, d: load(s, d, "companies").select("company_id", identity.company_name_key(F.col("name")).alias("name_key")),
        f"select company_id, {_KEY} as name_key from companies",
    ),
    "f8_generic_inbox": (
        lambda s, d: _contacts(s, d).where("email <> ''").select("contact_id", identity.is_generic_inbox(F.col("email")).alias("generic")),
        f"select contact_id, {_GENERIC} as generic from contacts where email <> ''",
    ),
    "f10_f11_address_kind": (
        lambda s, d: _person(s, d).select("contact_id", identity.address_kind(F.col("email"), F.col("person"), F.when(F.col("contact_id") % 3 == 0, True).when(F.col("contact_id") % 3 == 1, False)).alias("x")).select("contact_id", "x.*"),
        f"""with p as (select contact_id, lower(trim(email)) as email, cast(contact_id % 500 as varchar) as k, contact_id % 4 = 0 as short, contact_id % 3 = 0 as ok from contacts),
 m as (select *, split_part(split_part(email, '@', 1), '+', 1) as l, {_GENERIC} as g from p),
 r as (select *, case when email = '' then false when g then false when short and length('p' || k) >= 2 then l = 'p' || k when not short then l in ('jane' || 'p' || k, 'p' || k || 'jane', 'j' || 'p' || k) else false end as person from m)
 select contact_id, case when email = '' then 'unknown' when g then 'generic' when person then 'personal' else 'named_unmatched' end as kind, email <> '' and person and ok as verified from r""",
    ),
    "f20_f21_bands_and_rungs": (
        lambda s, d: filters.bands(load(s, d, "emails"), _contacts(s, d)),
        """select e.email_id, case when seniority_rank <= 3 then 'executive' when seniority_rank <= 8 then 'lead' when seniority_rank <= 15 then 'individual' when seniority_rank is not null then 'other' end as band,
 case when follow_up_step > 0 then follow_up_step when is_follow_up then null else 0 end as rung from emails e left join contacts c on c.contact_id = e.contact_id""",
    ),
    "p1_contact_search": (
        lambda s, d: filters.search(_contacts(s, d).join(load(s, d, "companies").select("company_id", F.col("name").alias("company_name")), "company_id", "left"), ["name", "email", "company_name", "status"], "firm 7").select("contact_id"),
        "select c.contact_id from contacts c left join companies co on co.company_id = c.company_id where c.name ilike '%firm 7%' or c.email ilike '%firm 7%' or co.name ilike '%firm 7%' or c.status ilike '%firm 7%'",
    ),
    "p2_company_search": (
        lambda s, d: filters.search(load(s, d, "companies"), ["name", "scrape_status"], "labs").select("company_id"),
        "select company_id from companies where name ilike '%labs%' or scrape_status ilike '%labs%'",
    ),
    "p3_contact_view_counts": (
        lambda s, d: filters.contact_view_counts(_contacts(s, d), load(s, d, "emails")),
        """with e as (select contact_id, count(*) as n, count_if(has_response and response_verified_at is not null) as v from emails group by contact_id),
 c as (select c.*, coalesce(n, 0) as n, coalesce(v, 0) as v from contacts c left join e on e.contact_id = c.contact_id)
 select unnest(['active', 'archived', 'personal_email', 'replied', 'senior', 'uncontacted', 'verified']) as view,
 unnest([count_if(status <> 'archived'), count_if(status = 'archived'), count_if(email_kind = 'personal' or person_verified), count_if(v > 0), count_if(coalesce(seniority_rank, 99) <= 5), count_if(n = 0), count_if(person_verified)])::bigint as n from c""",
    ),
    "p4_company_views": (
        lambda s, d: load(s, d, "companies").where("scrape_status in ('scraped', 'no_emails_found')").join(_contacts(s, d).select("company_id").distinct(), "company_id", "left_semi").select("company_id", "scrape_status"),
        "select company_id, scrape_status from companies c where scrape_status in ('scraped', 'no_emails_found') and exists (select 1 from contacts x where x.company_id = c.company_id)",
    ),
    "p10_outreach_addresses": (
        lambda s, d: _contacts(s, d).select("contact_id", identity.is_outreach_address(F.col("email")).alias("fine")),
        f"""with p as (select contact_id, lower(trim(email)) as e from contacts) select contact_id, length(e) - length(replace(e, '@', '')) = 1 and split_part(e, '@', 1) <> '' and split_part(e, '@', 2) <> ''
 and split_part(e, '@', 1) not in ({_quoted(identity.BAD_LOCALS)}) and split_part(e, '@', 2) not in ({_quoted(identity.BAD_DOMAINS)}) and length(e) <= 80 as fine from p""",
    ),
    "f17_name_from_address": (
        lambda s, d: load(s, d, "supplier").select("s_suppkey", identity.name_from_local(F.concat(F.lit("jane."), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij"), F.lit("@x.org"))).alias("name")),
        """with p as (select s_suppkey, translate(cast(s_suppkey as varchar), '0123456789', 'abcdefghij') as l from supplier)
 select s_suppkey, case when length(l) >= 2 then concat('Jane ', upper(l[1]), l[2:]) end as name from p""",
    ),
    "j8_suppression_match": (
        lambda s, d: suppression.match(_contacts(s, d), load(s, d, "suppressions"), "contact_id", "email"),
        f"with {_MATCH} select contact_id, suppression_id, kind, value from picked where n = 1",
    ),
    "j9_suppression_coverage": (
        lambda s, d: suppression.coverage(_contacts(s, d), load(s, d, "suppressions"), "contact_id", "email"),
        f"with {_MATCH} select s.suppression_id, s.kind, s.value, count(distinct h.contact_id) as matched from suppressions s left join hits h on h.suppression_id = s.suppression_id group by 1, 2, 3",
    ),
    "u9_suppression_first_entries": (
        lambda s, d: suppression.first_entries(load(s, d, "suppressions")).select("suppression_id", "kind", "value"),
        "select suppression_id, kind, value from (select *, row_number() over (partition by kind, value order by created_at, suppression_id) as n from suppressions) where n = 1",
    ),
    "a19_duplicate_addresses": (
        lambda s, d: duplicates.duplicate_keys(_contacts(s, d), F.lower("email")),
        "select lower(email) as key, count(*) as n from contacts where coalesce(email, '') <> '' group by 1 having count(*) > 1",
    ),
    "a19_addresses_across_companies": (
        lambda s, d: duplicates.duplicate_keys(_contacts(s, d), F.lower("email"), "company_id"),
        "select lower(email) as key, count(distinct company_id) as n from contacts where coalesce(email, '') <> '' group by 1 having count(distinct company_id) > 1",
    ),
    "w5_keepers": (_kept, f"with {_KEEP} select contact_id, keep_id from keep where n > 1"),
    "u1_collapse_contacts": (
        lambda s, d: duplicates.collapse(_contacts(s, d), _kept(s, d), "contact_id").select("contact_id", "email"),
        f"with {_KEEP} select contact_id, email from contacts where contact_id not in (select contact_id from keep where contact_id <> keep_id)",
    ),
    "j19_repoint_emails": (
        lambda s, d: duplicates.repoint(load(s, d, "emails").select("email_id", "contact_id"), _kept(s, d), "contact_id"),
        f"with {_KEEP} select e.email_id, coalesce(k.keep_id, e.contact_id) as contact_id from emails e left join keep k on k.contact_id = e.contact_id",
    ),
    "u2_clear_across_companies": (
        lambda s, d: duplicates.clear_on_losers(_contacts(s, d), _kept_across(s, d), "contact_id", "email").select("contact_id", "email"),
        f"with {_KEEP_ACROSS} select c.contact_id, case when k.keep_id <> c.contact_id then '' else c.email end as email from contacts c left join keep k on k.contact_id = c.contact_id",
    ),
    "u3_company_name_keys": (
        lambda s, d: duplicates.unique_name_keys(load(s, d, "companies"), identity.company_name_key(F.col("name")), F.col("company_id").cast("string")).select("company_id", "name_key"),
        f"""with k as (select company_id, {_KEY} as k, created_at from companies), r as (select *, row_number() over (partition by k order by created_at, company_id) as n from k)
 select company_id, case when k is null then null when n = 1 then k else concat(k, ':', cast(company_id as varchar)) end as name_key from r""",
    ),
    "u3_company_domain_keepers": (
        lambda s, d: duplicates.keepers(load(s, d, "companies"), "company_id", [F.col("domain")], [F.col("created_at")]),
        """select company_id, keep_id from (select company_id, first_value(company_id) over (partition by domain order by created_at, company_id) as keep_id,
 count(*) over (partition by domain) as n from companies where domain is not null) where n > 1""",
    ),
    "w1_first_in_batch": (
        lambda s, d: windows.first_in_batch(load(s, d, "emails").where("scheduled_at is not null and recipient_email is not null").withColumn("day", F.to_date("scheduled_at")), ["day"], "email_id").select("email_id", "place"),
        "select email_id, row_number() over (partition by cast(scheduled_at as date), lower(recipient_email), is_follow_up order by email_id) as place from emails where scheduled_at is not null and recipient_email is not null",
    ),
    "w2_daily_cap": (
        lambda s, d: windows.daily_cap(load(s, d, "emails").where("sent_at is not null").withColumn("co", F.coalesce("company_id", F.lit(-1))), "co", "sent_at", "email_id", 2).select("email_id", "over_cap"),
        "select email_id, row_number() over (partition by coalesce(company_id, -1), cast(sent_at as date) order by sent_at, email_id) > 2 as over_cap from emails where sent_at is not null",
    ),
    "w3_burst": (
        lambda s, d: windows.burst(load(s, d, "activity"), "entity_id", "created_at", 3600).select("event_id", "in_window", "retry_after"),
        """select event_id, count(*) over w as in_window, round(3600 - (epoch_us(created_at) - min(epoch_us(created_at)) over w) / 1e6 + 0.05, 2) as retry_after from activity
 window w as (partition by entity_id order by epoch_us(created_at) range between 3599999999 preceding and current row)""",
    ),
    "w7_newest_messages": (
        lambda s, d: windows.newest_messages(load(s, d, "messages"), 3),
        """select thread_id, message_no, kind, greatest(0, n - 3) as older_omitted from (select *, row_number() over (partition by thread_id order by message_no desc) as r, count(*) over (partition by thread_id) as n from messages) where r <= 3""",
    ),
    "a31_w10_thread_counters": (
        lambda s, d: windows.thread_counters(load(s, d, "messages")),
        """select thread_id, cast(count_if(kind = 'REPLY') as bigint) as replies, cast(count_if(kind = 'OWN') as bigint) as own, cast(count_if(kind = 'AUTO') as bigint) as auto,
 max(case when kind = 'REPLY' then message_no end) as last_reply, max(case when kind = 'AUTO' then message_no end) as last_auto from messages group by thread_id""",
    ),
    "w11_oldest_due_batch": (
        lambda s, d: windows.oldest_due_batch(load(s, d, "emails").where("scheduled_at is not null").withColumn("job", F.col("email_id") % 50), "job", "scheduled_at", AS_OF).select("email_id", "job"),
        f"""with q as (select email_id, email_id % 50 as job, scheduled_at from emails where scheduled_at is not null and scheduled_at <= {AS_OF})
 select email_id, job from q where job = (select job from q order by scheduled_at, email_id limit 1)""",
    ),
    "a20_daily_usage": (
        lambda s, d: windows.daily_usage(load(s, d, "activity"), ["click", "purchase"], 5),
        "select entity_id, cast(created_at as date) as day, cast(count_if(event in ('click', 'purchase')) as bigint) as used, greatest(0, 5 - cast(count_if(event in ('click', 'purchase')) as bigint)) as remaining from activity group by 1, 2",
    ),
    "j20_previous_touch": (
        lambda s, d: windows.previous_touch(load(s, d, "emails")),
        """select contact_id, email_id from (select contact_id, email_id, row_number() over (partition by contact_id order by sent_at desc nulls last, email_id desc) as n
 from emails where status = 'sent' and contact_id is not null) where n = 1""",
    ),
    "o5_s10_latest_activity": (
        lambda s, d: load(s, d, "activity").orderBy(F.desc("event_id")).limit(30).select("event_id", "event"),
        "select event_id, event from activity order by event_id desc limit 30",
    ),
    "f47_extractive_summary": (
        lambda s, d: filters.summaries(load(s, d, "documents")),
        """select doc_id, substr(array_to_string(list_filter(regexp_extract_all(replace(text, chr(10), ' '), '[^.!?]+[.!?]*'), lambda x: length(trim(x)) > 40)[:3], ''), 1, 400) as summary from documents""",
    ),
}
