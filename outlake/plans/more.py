"""Registered queries: gates and repairs, streams, text of pages and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlake.functions import identity, text
from outlake.operators import gates, links, pipeline
from outlake.plans.entities import _MATCH
from outlake.plans.reports import _AS_SENT, _EVIDENCE, _FLAGS, _FOLLOW
from outlake.plans.views import load
from outlake.sources.store import event_stream, safe_cell
from outlake.streaming import streams

_DOMAINS = "select distinct lower(regexp_replace(email, '^.*@', '')) as domain from contacts where email <> ''"

_REASONS = f"""{_FLAGS}, dest as (select e.*, coalesce(e.recipient_email, c.email) as addr, c.bounced_at as cb from emails e left join contacts c on c.contact_id = e.contact_id),
 box as (select email_id, split_part(lower(trim(addr)), '@', 1) as l, split_part(split_part(lower(trim(addr)), '@', 1), '+', 1) as head, split_part(lower(trim(addr)), '@', 2) as dom from dest where trim(coalesce(addr, '')) <> ''),
 blocked as (select distinct email_id from box join suppressions s on (s.kind = 'address' and concat(case when head <> '' then head else l end, '@', dom) = lower(s.value))
   or (s.kind = 'domain' and (dom = lower(s.value) or ends_with(dom, '.' || lower(s.value))))),
 r as (select t.email_id, is_follow_up, lower(addr) as addr, case when status not in ('draft', 'approved') then 'not sendable' when {_EVIDENCE} then 'already delivered' when send_attempted_at is not null then 'attempt pending'
 when coalesce(f.replied, false) then 'replied' when b.email_id is not null then 'suppressed' when cb is not null or coalesce(f.bounced_now, false) then 'bounced' when trim(coalesce(addr, '')) = '' then 'no address' end as reason
 from dest t left join flags f on f.contact_id = t.contact_id left join blocked b on b.email_id = t.email_id)"""


def _mx(s, d):
    """Mail acceptance by domain: some refuse, some are unknown."""
    domains = load(s, d, "contacts").where("email <> ''").select(F.lower(F.substring_index("email", "@", -1)).alias("domain")).distinct()
    return domains.withColumn("accepts", F.when(F.length("domain") % 3 == 0, False).when(F.length("domain") % 3 == 1, True))


MORE = {
    "g2_draft_gate": (
        lambda s, d: gates.draft_gate(load(s, d, "contacts"), load(s, d, "emails"), load(s, d, "suppressions"), 2),
        f"""with {_MATCH}, w as (select distinct contact_id from emails where not {_FOLLOW} and status in ('sent', 'draft', 'approved')),
 r as (select c.contact_id, c.company_id, case when trim(coalesce(email, '')) = '' then 'no email' when p.contact_id is not null then 'suppressed' when c.status = 'archived' then 'archived'
 when w.contact_id is not null then 'already contacted' end as reason from contacts c left join (select * from picked where n = 1) p on p.contact_id = c.contact_id left join w on w.contact_id = c.contact_id)
 select contact_id, coalesce(reason, case when row_number() over (partition by company_id, reason is null order by contact_id) > 2 then 'daily cap' else 'draft' end) as decision from r""",
    ),
    "g4_send_gate": (
        lambda s, d: gates.send_gate(load(s, d, "emails"), load(s, d, "contacts"), load(s, d, "suppressions")),
        f"""with {_REASONS}
 select email_id, coalesce(reason, case when row_number() over (partition by addr, is_follow_up, reason is null order by email_id) > 1 then 'duplicate' else 'send' end) as decision from r""",
    ),
    "g12_delivered_to_sent": (
        lambda s, d: gates.delivered_to_sent(load(s, d, "emails")).groupBy("status").agg(F.count("*").alias("n")),
        f"select case when {_EVIDENCE} then 'sent' else status end as status, count(*) as n from emails group by 1",
    ),
    "g15_unverified_flags": (
        lambda s, d: load(s, d, "emails").where("has_response and response_verified_at is null").groupBy("email_type").agg(F.count("*").alias("n")),
        "select email_type, count(*) as n from emails where has_response and response_verified_at is null group by 1",
    ),
    "g17_replied_contacts": (
        lambda s, d: gates.replied_contacts(load(s, d, "contacts"), load(s, d, "emails")).select("contact_id", "status"),
        """select contact_id, case when status <> 'archived' and contact_id in (select contact_id from emails where has_response and response_verified_at is not null) then 'replied' else status end as status from contacts""",
    ),
    "j3_company_drill_down": (
        lambda s, d: load(s, d, "emails").join(load(s, d, "contacts").where("company_id = 7").select("contact_id"), "contact_id").select("email_id", "contact_id", "status"),
        "select email_id, e.contact_id, e.status from emails e join contacts c on c.contact_id = e.contact_id where c.company_id = 7",
    ),
    "j13_mail_acceptance": (
        lambda s, d: gates.acceptance_gate(load(s, d, "contacts"), _mx(s, d)),
        f"""with mx as (select domain, case when length(domain) % 3 = 0 then false when length(domain) % 3 = 1 then true end as accepts from ({_DOMAINS}))
 select contact_id, coalesce(accepts, true) as passes from contacts c left join mx on mx.domain = lower(regexp_replace(c.email, '^.*@', ''))""",
    ),
    "j18_protected_delete": (
        lambda s, d: gates.protected_delete(load(s, d, "contacts").where("status = 'archived'").select("contact_id"), load(s, d, "emails")),
        """select contact_id, case when contact_id in (select contact_id from emails where status = 'sent' or gmail_message_id is not null or send_attempted_at is not null) then 'protected' else 'deleted' end as outcome
 from contacts where status = 'archived'""",
    ),
    "a26_kind_histogram": (
        lambda s, d: load(s, d, "contacts").groupBy("email_kind").agg(F.count("*").alias("n")),
        "select email_kind, count(*) as n from contacts group by 1",
    ),
    "a33_send_decisions": (
        lambda s, d: load(s, d, "emails").groupBy("status", "email_type").agg(F.count_if(pipeline.counts_as_sent()).cast("long").alias("sent"), F.count("*").alias("n")),
        f"select status, email_type, cast(count_if({_AS_SENT}) as bigint) as sent, count(*) as n from emails group by 1, 2",
    ),
    "o3_contact_sort": (
        lambda s, d: load(s, d, "contacts").orderBy(F.coalesce("seniority_rank", F.lit(99)), F.lower("name"), "contact_id").offset(50).limit(25).select("contact_id", "seniority_rank"),
        "select contact_id, seniority_rank from contacts order by coalesce(seniority_rank, 99), lower(name), contact_id limit 25 offset 50",
    ),
    "s5_safe_cells": (
        lambda s, d: load(s, d, "documents").select("doc_id", F.md5(safe_cell(F.concat(F.when(F.col("doc_id") % 3 == 0, "=").when(F.col("doc_id") % 3 == 1, "\t").otherwise(""), F.col("text")))).alias("digest")),
        "select doc_id, md5(case when doc_id % 3 = 0 then concat('''=', text) when doc_id % 3 = 1 then concat('''', chr(9), text) when left(text, 1) in ('=', '+', '-', '@', chr(9), chr(13)) then concat('''', text) else text end) as digest from documents",
    ),
    "f30_clean_text": (lambda s, d: load(s, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned")), None),
    "f37_visible_text": (
        lambda s, d: load(s, d, "pages").select("page_id", text.visible_text(F.col("html")).alias("text")),
        r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as text from pages""",
    ),
    "f39_o10_page_links": (
        lambda s, d: load(s, d, "pages").select("page_id", F.posexplode(F.slice(text.links(F.col("html")), 1, 24)).alias("place", "href")),
        """select page_id, cast(i as integer) as place, l[i + 1] as href from (select page_id, l, unnest(range(0, least(24, len(l)))) as i from (select page_id, regexp_extract_all(html, '(?i)<a[^>]+href="([^"]*)"', 1) as l from pages))""",
    ),
    "f39_o10_ranked_links": (lambda s, d: links.page_links(load(s, d, "pages")), None),
    "a25_largest_estimate": (
        lambda s, d: load(s, d, "documents").select("source", text.largest_number(F.col("text")).alias("n")).groupBy("source").agg(F.max("n").alias("estimate")),
        r"""select source, max(n) as estimate from (select source, list_max(list_filter(list_transform(regexp_extract_all(text, '\b(\d{1,6})\b', 1), lambda x: cast(x as integer)), lambda x: x between 2 and 50000)) as n from documents) group by source""",
    ),
    "t1_activity_feed": (
        lambda s, d: streams.feed(event_stream(s, d)).select("event_id", "entity_id", "event"),
        "select event_id, entity_id, event from activity",
    ),
    "t2_daily_counts": (
        lambda s, d: streams.daily_counts(event_stream(s, d)),
        "select cast(created_at as date) as day, event, count(*) as n from activity group by 1, 2",
    ),
    "t7_once_per_actor": (
        lambda s, d: streams.once_per_actor(event_stream(s, d)),
        "select distinct entity_id, event from activity",
    ),
    "t4_due_sweep": (
        lambda s, d: load(s, d, "emails").where("scheduled_at is not null").select("email_id", streams.due_class(F.col("scheduled_at"), F.expr("timestamp_ntz '1998-06-01 00:00:00'"), 24 * 365).alias("class")),
        """select email_id, case when scheduled_at > timestamp '1998-06-01 00:00:00' then 'future' when scheduled_at < timestamp '1998-06-01 00:00:00' - interval '8760' hour then 'stale' else 'due' end as class
 from emails where scheduled_at is not null""",
    ),
    "t9_last_state": (
        lambda s, d: streams.last_state(load(s, d, "activity"), ["error"], ["signup", "purchase"]),
        """select entity_id, event = 'error' as "on" from (select *, row_number() over (partition by entity_id order by created_at desc, event_id desc) as n from activity where event in ('error', 'signup', 'purchase')) where n = 1""",
    ),
}
