"""Registered queries: gates, repairs, effects of edits, keyed streams, sorts and views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outlake.functions import identity, people, schedule
from outlake.operators import filters, followups, gates, pipeline, states, terms
from outlake.plans.entities import _quoted
from outlake.plans.people import _WINDOW, PARTS, known, window
from outlake.plans.reports import _EVIDENCE, _EVIDENCED, _FLAGS, _FOLLOW, _board
from outlake.plans.views import load
from outlake.sources import store
from outlake.sources.store import event_stream, spread
from outlake.streaming import keyed, streams, timed

_LEFT = "(status = 'sent' or gmail_message_id is not null or send_attempted_at is not null)"
_ATTACH = """select *, email_id % 3 = 0 as claims, case when email_id % 4 < 3 then email_id % 4 end as resume_id, case when email_id % 10 = 7 then cast(2 as bigint) end as override_id, case when email_id % 7 < 6 then cast(1 as bigint) end as default_id, email_id % 11 <> 0 as attach from {0}"""
_SUBJECT = "select *, concat('Hello ', cast(email_id % 5 as varchar(20))) as subject from {0}"
_SENT = """select concat('g', cast(case when email_id % 2 = 0 then email_id else email_id + 1000000 end as varchar(20))) as message_id, case when email_id % 3 = 0 then upper(recipient_email) else recipient_email end as recipient, concat('Hello ', cast(email_id % 5 as varchar(20))) as subject,
 created_at + (email_id % 7 - 2) * interval '30' second as at from {0} where recipient_email is not null"""
_RICH = """select c.*, case when c.company_id % 3 <> 0 then concat('About ', c.name) end as summary, case when c.company_id % 4 = 0 then 'a note' end as discovery_note from {0} c"""
_TRUST = "(company_id % 3 <> 0 and domain is not null)"
_DUE = "timestamp '1998-06-01 00:00:00'"
_SORTS = {
    "name": ["lower(person)"], "company": ["lower(coalesce(company, ''))", "lower(person)"], "status": ["status"], "seniority": ["coalesce(seniority_rank, 99)"], "verified": ["case when accepts then 0 else 1 end"],
    "newest": ["-contact_id"], "profile": ["case when coalesce(profile, '') = '' then 1 else 0 end"], "kind": ["length(trim(address))"], "title": ["lower(coalesce(title, ''))"],
}
_VIEWS = {
    "active": "status <> 'archived'", "uncontacted": "n_sent = 0", "replied": "replied > 0", "archived": "status = 'archived'", "verified": "person_verified", "personal_email": "kind = 'personal' or email_verified",
    "has_linkedin": "coalesce(profile, '') <> ''", "linkedin_verified": "profile_verified", "affinity": "coalesce(notes, '') ilike '%criteria match%'", "senior": "coalesce(seniority_rank, 99) <= 5",
}
_PAYLOAD = """concat('{{"team": [{{"name": "', person, '", "email": "', case when address like '%@%' then trim(address) else '' end, '"}}, {{"fullName": "About us", "email": "a@b.example.com"}}, {{"items": {{"lead": {{"full_name": "Ana", "linkedin": "', coalesce(profile, ''), '"}}}}}}], "n": 3}}')"""


def _sql(template: str):
    return lambda s, d, *names: s.sql(template.format("{t}"), t=load(s, d, names[0]))


def _rich(s, d):
    return _sql(_RICH)(s, d, "companies")


def _edits(s, d):
    return load(s, d, "people").where("trim(address) <> ''").select("contact_id", F.trim("address").alias("new_email"), (F.col("contact_id") % 10 == 0).alias("force"))


def _page_links(s, d):
    p = spread(load(s, d, "people").select("contact_id", "company_id", "person", "profile")).where("company_id is not null")
    return p.select(F.col("company_id").alias("page_id"), "contact_id", "person"), p.where("profile is not null").select(F.col("company_id").alias("page_id"), F.col("contact_id").alias("place"), F.col("profile").alias("url"))


#: Criteria by name: words of titles, a phrase of short words, and schools with their other names.
_CRITERIA = """select case result_id % 3 when 0 then 'head of sales' when 1 then 'partner firm' else 'chief officer' end as criterion, case result_id % 3 when 0 then 'Head of Sales' when 1 then 'partner, firm' else 'Chief  Officer' end as term, 'role' as place from {0} where result_id < 4
 union all select 'type ' || cast(result_id % 500 as varchar(20)), title, 'role' from {0} where length(title) > 3 and result_id % 4 = 1
 union all select 'penn', case result_id % 2 when 0 then 'Penn' else 'match: ML' end, 'education' from {0} where result_id < 3 union all select 'fair', 'met at a', 'education' from {0} where result_id = 1"""
#: Pages with an address and a source at their end, and records that quote their page, another, or nothing.
_PAGE_TEXTS = "select doc_id as page_id, concat(text, ' write to Info', cast(doc_id % 50 as varchar(20)), '@site.io or see https://site.io/', cast(doc_id % 7 as varchar(20)), '.') as text from {0}"
_RECORDS = """select doc_id as record_id, case when doc_id % 11 = 0 then doc_id - 1 else doc_id end as page_id, case when doc_id % 5 = 0 then 'other@site.io' else concat(' info', cast(doc_id % 50 as varchar(20)), '@SITE.io') end as email,
 case doc_id % 3 when 0 then concat(chr(10), ' ', substr(text, 11, 60)) when 1 then upper(substr(text, 5, 30)) else substr(text, 5, 12) end as quote, case when doc_id % 4 = 0 then concat('https://site.io/', cast(doc_id % 9 as varchar(20))) else '' end as source_url from {0}"""


def _quotes(s, d):
    return _sql(_RECORDS)(s, d, "documents"), _sql(_PAGE_TEXTS)(s, d, "documents")


def _viewed(s, d):
    mail = load(s, d, "emails").where("contact_id is not null").groupBy("contact_id").agg(
        F.count_if(F.expr("status = 'sent'")).alias("n_sent"), F.count_if(F.expr("has_response and response_verified_at is not null")).alias("replied")
    )
    p = load(s, d, "people").withColumn("k", known()).select("*", "k.*").join(mail, "contact_id", "left")
    return p.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_sent", "replied")})


def _bound_queue(s, d):
    """Queued emails with their sender's window at a fixed moment."""
    q = load(s, d, "emails").where("scheduled_at is not null").withColumn("sender_id", F.col("company_id"))
    w = load(s, d, "send_windows").select("sender_id", schedule.is_open(window(), F.expr(_DUE)).alias("open"))
    return q.join(w, "sender_id", "left")


STATES = {
    "s1_newest_companies": (
        lambda s, d: load(s, d, "companies").orderBy(F.desc("created_at"), "company_id").select("company_id", "created_at"),
        "select company_id, created_at from companies order by created_at desc, company_id",
    ),
    "o12_suppressions_in_order": (
        lambda s, d: load(s, d, "suppressions").orderBy(F.desc("created_at"), "value", "suppression_id").select("suppression_id", "value"),
        "select suppression_id, value from suppressions order by created_at desc, value, suppression_id",
    ),
    "s6_decoded_details": (
        lambda s, d: load(s, d, "activity").select("event_id", F.coalesce(F.from_json(F.when(F.col("event_id") % 5 == 0, "junk").otherwise(F.col("detail")), "k int")["k"], F.lit(-1)).alias("k")),
        "select event_id, case when event_id % 5 = 0 then -1 else coalesce(try_cast(nullif(regexp_extract(detail, '\"k\": *(-?[0-9]+)', 1), '') as integer), -1) end as k from activity",
    ),
    "s8_people_in_payloads": (
        lambda s, d: store.people_in_json(load(s, d, "people").select("contact_id", F.expr(_PAYLOAD.replace("{{", "{").replace("}}", "}")).alias("payload")), "contact_id", "payload"),
        """select contact_id, cast((case when person <> '' and address like '%@%' then 1 else 0 end) + (case when lower(coalesce(profile, '')) like '%linkedin.com%' then 1 else 0 end) as bigint) as n from people""",
    ),
    "s9_flat_messages": (
        lambda s, d: store.flat_messages(load(s, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.col("conv_id").alias("id"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))).alias("thread"))),
        "select conv_id as thread_id, cast(row_number() over (partition by conv_id order by turn, role, text) - 1 as integer) as place, role, text from conversations",
    ),
    "s10_appended_activity": (
        lambda s, d: store.appended([load(s, d, "activity").where("event_id % 2 = 0"), load(s, d, "activity").where("event_id % 2 = 1")]).orderBy(F.desc("event_id")).limit(30).select("event_id", "event"),
        "select event_id, event from activity order by event_id desc limit 30",
    ),
    "p1_contact_search_in_company": (
        lambda s, d: filters.search(load(s, d, "people").where("company_id = 7"), ["person", "address", "title", "notes", "profile", "company"], "firm").select("contact_id"),
        "select contact_id from people where company_id = 7 and (person ilike '%firm%' or address ilike '%firm%' or title ilike '%firm%' or notes ilike '%firm%' or profile ilike '%firm%' or company ilike '%firm%')",
    ),
    "p2_company_search_in_full": (
        lambda s, d: filters.search(_rich(s, d).withColumn("industry", F.col("scrape_status")), ["name", "industry", "summary"], "5").select("company_id"),
        f"with r as ({_RICH.format('companies')}) select company_id from r where name ilike '%5%' or scrape_status ilike '%5%' or summary ilike '%5%'",
    ),
    "p3_contact_views": (
        lambda s, d: _viewed(s, d).agg(*[F.count_if(F.coalesce(F.expr(p), F.lit(False))).cast("long").alias(v) for v, p in _VIEWS.items()]),
        f"""with {PARTS}, m as (select contact_id, count_if(status = 'sent') as n_sent, count_if(has_response and response_verified_at is not null) as replied from emails where contact_id is not null group by 1),
 v as (select k.*, coalesce(n_sent, 0) as n_sent, coalesce(replied, 0) as replied from known k left join m using (contact_id)) select {", ".join(f"cast(count_if(coalesce({p}, false)) as bigint) as {v}" for v, p in _VIEWS.items())} from v""",
    ),
    "p4_company_view_counts": (
        lambda s, d: load(s, d, "companies").join(load(s, d, "contacts").select("company_id").distinct().withColumn("has", F.lit(True)), "company_id", "left").agg(
            *[F.count_if(F.expr(p)).cast("long").alias(v) for v, p in {"researched": "scrape_status = 'scraped'", "needs_research": "scrape_status <> 'scraped'", "with_contacts": "has", "without_contacts": "has is null"}.items()]
        ),
        """with h as (select c.*, exists (select 1 from contacts x where x.company_id = c.company_id) as has from companies c)
 select cast(count_if(scrape_status = 'scraped') as bigint) as researched, cast(count_if(scrape_status <> 'scraped') as bigint) as needs_research, cast(count_if(has) as bigint) as with_contacts, cast(count_if(not has) as bigint) as without_contacts from h""",
    ),
    "o3_contact_sorts": (
        lambda s, d: filters.sorted_places(load(s, d, "people"), _SORTS, "contact_id", 10),
        " union all ".join(f"select '{k}' as sort, contact_id, place from (select contact_id, row_number() over (order by {', '.join(c)}, contact_id) as place from people) where place <= 10" for k, c in _SORTS.items()),
    ),
    "o4_clamped_page": (
        lambda s, d: filters.page(load(s, d, "people"), ["lower(person)", "contact_id"], 10_000, 25).select("contact_id"),
        "with n as (select count(*) as n from people), r as (select contact_id, row_number() over (order by lower(person), contact_id) - 1 as i from people) select contact_id from r, n where i // 25 = greatest(0, (n - 1) // 25)",
    ),
    "w14_first_wordings": (
        lambda s, d: load(s, d, "runs").withColumn("n", F.row_number().over(W.partitionBy("company_id", F.lower("bullet_2")).orderBy("run_id"))).where("n = 1").select("run_id", "company_id", "bullet_2"),
        "select run_id, company_id, bullet_2 from (select *, row_number() over (partition by company_id, lower(bullet_2) order by run_id) as n from runs) where n = 1",
    ),
    "w15_queue_order": (
        lambda s, d: states.queue_order(load(s, d, "emails")),
        f"select email_id, company_id, row_number() over (partition by company_id order by scheduled_at, email_id) as place from emails where scheduled_at is not null and not {_EVIDENCE} and status <> 'trashed'",
    ),
    "j1_decorated_flags": (
        lambda s, d: pipeline.decorated(load(s, d, "emails"), load(s, d, "contacts"), load(s, d, "companies"), followups.contact_flags(load(s, d, "emails"), load(s, d, "contacts")), followups.has_follow_up(load(s, d, "emails"))),
        f"""with {_FLAGS}, fu as (select * from emails where {_FOLLOW} and status <> 'trashed'),
 h as (select email_id, email_id in (select original_email_id from fu where original_email_id is not null) or coalesce(contact_id in (select contact_id from fu where contact_id is not null), false) as has_follow_up from emails),
 cf as (select contact_id, bool_or(has_response and response_verified_at is not null) as replied, bool_or(has_response and response_verified_at is null) as unv, bool_or({_FOLLOW} and status not in ('sent', 'trashed')) as pend, cast(count_if({_FOLLOW} and status = 'sent') as bigint) as fs from emails where contact_id is not null group by 1)
 select e.email_id, coalesce(recipient_email, c.email) as recipient, c.name as contact_name, o.name as company_name, has_follow_up, coalesce(cf.replied, false) as replied, coalesce(unv, false) as reply_unverified, coalesce(pend, false) as follow_up_pending, coalesce(fs, 0) as follow_ups_sent
 from emails e left join contacts c on c.contact_id = e.contact_id left join companies o on o.company_id = c.company_id left join cf on cf.contact_id = e.contact_id join h on h.email_id = e.email_id""",
    ),
    "a17_waiting": (
        lambda s, d: _board(s, d).agg(F.count_if(F.expr("stage in ('ready', 'drafted') and not (queued_count > 0 and pending_draft_count = 0)")).cast("long").alias("waiting_on_you"), F.count_if(F.expr("stage = 'awaiting'")).cast("long").alias("waiting_on_them"), F.coalesce(F.sum(F.expr("case when stage = 'drafted' then queued_count end")), F.lit(0)).alias("queued"), F.count_if("drift").cast("long").alias("drifted")),
        f"""with {_EVIDENCED} select cast(count_if(stage in ('ready', 'drafted') and not (queued_count > 0 and pending_draft_count = 0)) as bigint) as waiting_on_you, cast(count_if(stage = 'awaiting') as bigint) as waiting_on_them,
 cast(coalesce(sum(case when stage = 'drafted' then queued_count end), 0) as bigint) as queued, cast(count_if(drift) as bigint) as drifted from drifting""",
    ),
    "p18_attachment_conflicts": (
        lambda s, d: states.attachment_conflicts(_sql(_ATTACH)(s, d, "emails")),
        f"""with a as ({_ATTACH.format('emails')}), k as (select a.*, case when a.is_follow_up then o.email_type else a.email_type end as kind from a left join emails o on o.email_id = a.original_email_id),
 r as (select *, case when attach and coalesce(kind, 'sales') <> 'sales' then coalesce(override_id, resume_id, default_id) end as resolved from k)
 select email_id, case when not claims then null when resolved is null then 'nothing would be attached' when resolved <> coalesce(resume_id, default_id) then 'another resume would be attached' end as reason from r""",
    ),
    "g5_attachment_batch": (
        lambda s, d: states.attachment_conflicts(_sql(_ATTACH)(s, d, "emails")).join(load(s, d, "emails").where(~pipeline.has_evidence() & F.expr("status in ('draft', 'approved')")).select("email_id"), "email_id", "left_semi").groupBy(F.when(F.col("reason").isNull(), "sendable").otherwise("contradicted").alias("batch")).agg(F.count("*").alias("n")),
        f"""with a as ({_ATTACH.format('emails')}), k as (select a.*, case when a.is_follow_up then o.email_type else a.email_type end as kind from a left join emails o on o.email_id = a.original_email_id),
 r as (select *, case when attach and coalesce(kind, 'sales') <> 'sales' then coalesce(override_id, resume_id, default_id) end as resolved from k where status in ('draft', 'approved') and not {_EVIDENCE})
 select case when claims and (resolved is null or resolved <> coalesce(resume_id, default_id)) then 'contradicted' else 'sendable' end as batch, count(*) as n from r group by 1""",
    ),
    "j17_reconciled_attempts": (
        lambda s, d: states.reconciled(_sql(_SUBJECT)(s, d, "emails"), _sql(_SENT)(s, d, "emails")),
        f"""with e as ({_SUBJECT.format('emails')}), m as ({_SENT.format('emails').replace('as at from', 'as t from')}), f as (select * from m where message_id not in (select gmail_message_id from emails where gmail_message_id is not null)),
 p as (select * from e where not {_EVIDENCE} and send_attempted_at is not null and status <> 'trashed'), h as (select p.email_id, arg_min(f.message_id, (f.t, f.message_id)) as message_id from p join f on lower(p.recipient_email) = lower(f.recipient) and p.subject = f.subject and f.t >= p.send_attempted_at - interval '60' second group by 1)
 select p.email_id, message_id, case when message_id is not null then 'delivered' else 'unknown' end as outcome from p left join h using (email_id)""",
    ),
    "j18_cascaded_delete": (
        lambda s, d: states.deletion(load(s, d, "companies").where("scrape_status = 'pending'"), load(s, d, "contacts"), load(s, d, "emails")),
        f"""with p as (select contact_id, company_id, contact_id in (select contact_id from emails where {_LEFT} and contact_id is not null) as stays from contacts where company_id in (select company_id from companies where scrape_status = 'pending')),
 f as (select c.company_id, bool_or(coalesce(stays, false)) as stays from companies c left join p using (company_id) where c.scrape_status = 'pending' group by 1)
 select 'company' as kind, company_id as id, case when stays then 'protected' else 'deleted' end as outcome from f union all select 'contact', contact_id, case when stays then 'protected' else 'deleted' end from p
 union all select 'email', email_id, case when stays then 'protected' else 'deleted' end from emails join p using (contact_id)""",
    ),
    "j14_linked_profiles": (
        lambda s, d: states.linked_profiles(*_page_links(s, d)),
        f"""with {PARTS}, l as (select company_id, contact_id as place, profile as url, sp from pb where slug is not null and company_id is not null), p as (select company_id, contact_id, tok from pb where company_id is not null and len(tok) > 0),
 j as (select p.company_id as page_id, p.contact_id, tok, place, url, list_filter(sp, lambda x: not ((regexp_full_match(x, '[a-f0-9]{{5,}}') and not list_contains(tok, x)) or regexp_full_match(x, '[0-9]{{2,}}'))) as kept from p join l on l.company_id = p.company_id),
 m as (select * from j where case when len(tok) >= 2 then (list_contains(kept, tok[1]) and list_contains(kept, tok[-1])) or array_to_string(kept, '') in (tok[1] || tok[-1], tok[-1] || tok[1], tok[1][1] || tok[-1]) else array_to_string(kept, '') = tok[1] end)
 select page_id, contact_id, arg_min(url, place) as url from m group by 1, 2""",
    ),
    "f16_off_domain_notes": (
        lambda s, d: states.off_domain_notes(load(s, d, "people").withColumn("notes", F.when(F.col("contact_id") % 7 == 0, F.lit(f"Not on x. {states.WARNING} y.")).when(F.col("contact_id") % 5 == 0, F.col("notes"))), load(s, d, "companies"), load(s, d, "emails")),
        f"""with p as (select *, case when contact_id % 7 = 0 then 'Not on x. {states.WARNING} y.' when contact_id % 5 = 0 then notes end as nt from people where trim(address) <> ''),
 j as (select p.contact_id, p.nt, c.name, coalesce(array_to_string(string_split(c.domain, '.')[-2:], '.'), '') as home, coalesce(c.domain is not null and c.scrape_status <> 'wrong_site', false) as trusted,
  array_to_string(string_split(split_part(lower(trim(address)), '@', -1), '.')[-2:], '.') as own, p.status = 'replied' or p.contact_id in (select contact_id from emails where status = 'sent' and contact_id is not null) as engaged from p left join companies c on c.company_id = p.company_id),
 w as (select *, trusted and own <> home and not engaged as warranted from j), a as (select *, case when warranted and trim(coalesce(nt, '')) = '' then 'flag' when not warranted and nt like 'Not on %{states.WARNING}%' then 'clear' else 'keep' end as action from w)
 select contact_id, action, case action when 'flag' then concat('Not on ', home, '. {states.WARNING} ', name, ' before sending.') when 'keep' then nt end as note from a""",
    ),
    "g13_quarantined_companies": (
        lambda s, d: states.quarantined(_rich(s, d).withColumn("domain", F.when(F.col("company_id") % 3 == 0, "zebra.example.com").otherwise(F.col("domain")))).select("company_id", "domain", "summary", "scrape_status"),
        f"""with r as ({_RICH.format('companies')}), z as (select * exclude (domain), case when company_id % 3 = 0 then 'zebra.example.com' else domain end as domain from r), b as (select *, domain is not null and (scrape_status = 'wrong_site' or company_id % 3 = 0) as bad from z)
 select company_id, case when not bad then domain end as domain, case when not bad then summary end as summary, case when bad then 'wrong_site' else scrape_status end as scrape_status from b""",
    ),
    "g14_summaries_to_notes": (
        lambda s, d: states.summaries_to_notes(_rich(s, d)).select("company_id", "summary", "discovery_note"),
        f"""with r as ({_RICH.format('companies')}), m as (select *, coalesce(summary, '') <> '' and discovery_note is null and scrape_status in ({_quoted(list(states.UNSCRAPED))}) as moved from r)
 select company_id, case when not moved then summary end as summary, case when moved then summary else discovery_note end as discovery_note from m""",
    ),
    "g15_unverified_report": (
        lambda s, d: states.unverified_report(load(s, d, "emails")),
        """with m as (select date_trunc('minute', response_at) as minute from emails where response_at is not null group by 1 having count(*) >= 3)
 select count(*) as unverified, cast(count_if(date_trunc('minute', response_at) in (select minute from m)) as bigint) as batch_stamped from emails where has_response and response_verified_at is null""",
    ),
    "g8_research_status": (
        lambda s, d: load(s, d, "companies").join(load(s, d, "people").withColumn("k", known()).groupBy("company_id").agg(F.bool_or((F.col("person") != "") & ~F.col("name_from_email") & (F.col("k.profile_verified") | ((F.col("k.kind") != "generic") & (F.trim("address") != "") & F.col("k.email_verified")))).alias("reach")), "company_id", "left")
        .select("company_id", states.research_status(F.col("domain").isNotNull(), F.col("scrape_status") != "wrong_site", F.col("scrape_status") != "scrape_failed", F.coalesce("reach", F.lit(False))).alias("status")),
        f"""with {PARTS}, g as (select company_id, bool_or(person <> '' and not name_from_email and (profile_verified or (kind <> 'generic' and e <> '' and email_verified))) as reach from known group by 1)
 select c.company_id, case when domain is null then 'no_website' when scrape_status = 'wrong_site' then 'wrong_site' when scrape_status = 'scrape_failed' then 'scrape_failed' when coalesce(reach, false) then 'scraped' else 'no_emails_found' end as status from companies c left join g on g.company_id = c.company_id""",
    ),
    "g10_usable_channels": (
        lambda s, d: states.channels_met(load(s, d, "people").withColumn("known", known()), 2, 5),
        f"""with {PARTS}, u as (select company_id, person <> '' and not name_from_email as named, kind not in ('none', 'generic') and (email_verified or person_match) as em, profile_verified as pr from known),
 g as (select company_id, cast(count_if(named and (em or pr)) as bigint) as usable, cast(count_if(named and em) as bigint) as by_email, cast(count_if(named and pr) as bigint) as by_profile from u group by 1) select *, usable >= 2 as floor_met, usable >= 5 as target_met from g""",
    ),
    "g7_research_merge": (
        lambda s, d: states.research_merge(load(s, d, "people").withColumn("known", known()), load(s, d, "contacts"), load(s, d, "emails")),
        f"""with {PARTS}, j as (select c.contact_id, trim(coalesce(c.email, '')) as old, c.email_kind, c.name, trim(k.address) as nw, k.person, k.kind, k.email_verified or k.person_match as sure,
   c.contact_id not in (select contact_id from emails where {_LEFT} and contact_id is not null) as free from contacts c join known k on k.contact_id = c.contact_id),
 t as (select *, nw <> '' and free and (old = '' or (lower(old) <> lower(nw) and email_kind = 'generic' and kind = 'personal' and sure)) as takes from j)
 select contact_id, case when takes then nw else old end as email, case when takes or (nw <> '' and lower(old) = lower(nw)) then kind else email_kind end as email_kind, coalesce(nullif(name, ''), person) as name from t""",
    ),
    "g11_contact_edits": (
        lambda s, d: states.contact_edits(_edits(s, d), load(s, d, "contacts"), load(s, d, "emails")),
        f"""with d as (select contact_id, trim(address) as new_email, contact_id % 10 = 0 as force from people where trim(address) <> ''), j as (select d.*, lower(trim(coalesce(c.email, ''))) as old, c.bounced_at as cb, d.contact_id in (select contact_id from emails where {_LEFT} and contact_id is not null) as emailed
  from d join contacts c on c.contact_id = d.contact_id), o as (select *, case when lower(new_email) = old then 'same' when emailed and not force then 'refused' else 'changed' end as outcome from j),
 m as (select o.contact_id, cast(count_if(scheduled_at is not null) as bigint) as q, cast(count_if(bounced_at is not null and (recipient_email is null or lower(recipient_email) = old)) as bigint) as b from o join emails e on e.contact_id = o.contact_id group by 1)
 select o.contact_id, outcome, outcome = 'changed' and cb is not null as clears_bounce, case when outcome = 'changed' then coalesce(q, 0) else 0 end as dropped_schedules, case when outcome = 'changed' then coalesce(b, 0) else 0 end as cleared_rows from o left join m on m.contact_id = o.contact_id""",
    ),
    "f45_criteria_scores": (
        lambda s, d: terms.criteria_scores(spread(load(s, d, "people").select("contact_id", "title", F.col("notes").alias("evidence"))), _sql(_CRITERIA)(s, d, "results")),
        rf"""with cr as ({_CRITERIA.format('results')}), ps as (select contact_id, list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda w: w <> '') as r, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, notes)), '[^a-z0-9]+'), lambda w: w <> '') as b from people),
 ct as (select *, list_filter(regexp_split_to_array(lower(term), '[^a-z0-9]+'), lambda w: w <> '') as a from cr), cw as (select *, list_filter(a, lambda w: length(w) >= 3 or w in ({_quoted(terms.SHORT)})) as t from ct where len(a) > 0),
 m as (select contact_id, criterion, place from ps, cw where case when place = 'role' and len(t) > 0 then list_has_all(r, t) when place = 'role' then contains(' ' || array_to_string(r, ' ') || ' ', ' ' || array_to_string(a, ' ') || ' ') else contains(' ' || array_to_string(b, ' ') || ' ', ' ' || array_to_string(a, ' ') || ' ') end),
 g as (select contact_id, list_sort(list(distinct criterion)) as f, bool_or(place = 'education') as al from m group by 1)
 select ps.contact_id, round(coalesce(len(f), 0) / (select count(distinct criterion) from cr), 3) as score, coalesce(array_to_string(f, '|'), '') as matched, coalesce(al, false) as alumni_match from ps left join g using (contact_id)""",
    ),
    "f46_affinities": (
        lambda s, d: load(s, d, "people").select("contact_id", F.array_join(states.affinities(F.concat_ws(" ", "title", "notes"), ["Penn"], ["ML", "Robotics", "fair", "x"]), "|").alias("affinity")),
        r"""with b as (select contact_id, lower(concat_ws(' ', title, notes)) as l, ' ' || regexp_replace(lower(concat_ws(' ', title, notes)), '[^\p{L}\p{N}_]+', ' ', 'g') || ' ' as t from people)
 select contact_id, array_to_string(list_filter([case when contains(l, 'penn') then 'Penn' end, case when contains(t, ' robotics ') then 'Shared: Robotics' end, case when contains(t, ' fair ') then 'Shared: fair' end], lambda x: x is not null), '|') as affinity from b""",
    ),
    "f24_provenance_notes": (
        lambda s, d: load(s, d, "people").select("contact_id", states.provenance(known(), F.col("address"), F.col("profile"), F.when(F.col("contact_id") % 3 == 0, F.array(F.lit("ML"))).otherwise(F.array().cast("array<string>")), F.when(F.col("contact_id") % 2 == 0, F.col("domain"))).alias("note")),
        f"""with {PARTS} select contact_id, nullif(concat_ws(' ', case when contact_id % 3 = 0 then 'Warm match: ML. Verify before referencing it.' end, case when email_verified then 'Email verified as person-associated (name match + MX confirmed).' when person_match then 'Email local matches name; MX not confirmed yet.'
  when kind = 'generic' then 'Company/role inbox — not a specific person.' when e <> '' then 'Email local-part does not clearly match this person''s name.' end, case when profile_verified then 'LinkedIn URL slug matches this person''s name.' when coalesce(profile, '') <> '' then 'LinkedIn URL did not match this person''s name — not stored as verified.' end,
  case when contact_id % 2 = 0 then 'Source: ' || domain end), '') as note from known""",
    ),
    "f53_grounded_records": (
        lambda s, d: terms.grounded(*_quotes(s, d)),
        rf"""with g as ({_PAGE_TEXTS.format('documents')}), r as ({_RECORDS.format('documents')}), q as (select record_id, page_id, lower(trim(email)) as email, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) as quote, trim(source_url) as source from r),
 k as (select page_id, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as t, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.io') as known from g)
 select record_id, list_filter(known, lambda x: lower(x) = email)[1] as email from q join k using (page_id) where length(quote) >= 20 and len(list_filter(known, lambda x: lower(x) = email)) > 0 and contains(t, quote) and (source = '' or contains(text, source))""",
    ),
    "t4_due_in_windows": (
        lambda s, d: _bound_queue(s, d).select("email_id", F.when(streams.due_class(F.col("scheduled_at"), F.expr(_DUE).cast("timestamp_ntz"), 24 * 365) != "due", streams.due_class(F.col("scheduled_at"), F.expr(_DUE).cast("timestamp_ntz"), 24 * 365)).when(F.coalesce("open", F.lit(False)), "due").otherwise("waits").alias("class")),
        f"""with {_WINDOW}, o as (select sender_id, enabled and list_contains(days, isodow({_DUE} + shift) - 1) and hour({_DUE} + shift) >= start_hour and hour({_DUE} + shift) < end_hour as open from wn)
 select email_id, case when scheduled_at > {_DUE} then 'future' when scheduled_at < {_DUE} - interval '8760' hour then 'stale' when coalesce(open, false) then 'due' else 'waits' end as class from emails left join o on o.sender_id = company_id where scheduled_at is not null""",
    ),
    "a20_remaining_today": (
        lambda s, d: load(s, d, "activity").groupBy("entity_id", F.to_date("created_at").alias("day")).agg(F.count_if(F.expr("event = 'purchase'")).cast("long").alias("sent"), F.count_if(F.expr("event in ('click', 'view', 'signup')")).cast("long").alias("generated")).select("*", F.greatest(F.lit(0), 3 - F.col("sent")).alias("sends_left"), F.greatest(F.lit(0), 10 - F.col("generated")).alias("generations_left")),
        """with g as (select entity_id, cast(created_at as date) as day, cast(count_if(event = 'purchase') as bigint) as sent, cast(count_if(event in ('click', 'view', 'signup')) as bigint) as generated from activity group by 1, 2) select *, greatest(0, 3 - sent) as sends_left, greatest(0, 10 - generated) as generations_left from g""",
    ),
    "t2_daily_caps": (
        lambda s, d: keyed.latest(keyed.updates(event_stream(s, d).withWatermark("created_at", "1 day").groupBy(F.window("created_at", "1 day").alias("w"), "event").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event", "n")), ["day", "event"]).withColumn("left", F.greatest(F.lit(0), 300 - F.col("n"))),
        "select cast(created_at as date) as day, event, count(*) as n, greatest(0, 300 - count(*)) as \"left\" from activity group by 1, 2",
    ),
    "t3_bursts": (
        lambda s, d: timed.bursts(event_stream(s, d), 3600, "1 day"),
        """select event_id, count(*) over w as in_window, round(3600 - (epoch_us(created_at) - min(epoch_us(created_at)) over w) / 1e6 + 0.05, 2) as retry_after from activity
 window w as (partition by entity_id order by epoch_us(created_at) range between 3599999999 preceding and current row)""",
    ),
    "t5_streamed_reply_states": (
        lambda s, d: keyed.reply_states(event_stream(s, d), "click", "view", "purchase"),
        """select entity_id, coalesce(arg_max(event, (created_at, event_id)) filter (where event in ('click', 'view')) = 'click', false) as has_response, min(created_at) filter (where event = 'purchase') as bounced_at from activity where event in ('click', 'view', 'purchase') group by 1""",
    ),
    "t6_unsuppressed_events": (
        lambda s, d: keyed.unsuppressed(event_stream(s, d), lambda: load(s, d, "suppressions").select(F.col("suppression_id").alias("entity_id"))).select("event_id", "entity_id"),
        "select event_id, entity_id from activity where entity_id not in (select suppression_id from suppressions)",
    ),
    "t8_schedules": (
        lambda s, d: keyed.schedules(event_stream(s, d), "purchase", ["error", "click"]),
        """select entity_id, arg_max(event, (created_at, event_id)) = 'purchase' as scheduled from activity where event in ('purchase', 'error', 'click') group by 1""",
    ),
    "t9_streamed_opt_outs": (
        lambda s, d: keyed.opted_out(event_stream(s, d), ["error"], ["signup", "purchase"]),
        """select entity_id, arg_max(event, (created_at, event_id)) = 'error' as "on" from activity where event in ('error', 'signup', 'purchase') group by 1""",
    ),
    "u5_backfilled_name_keys": (
        lambda s, d: _backfilled(load(s, d, "companies")),
        f"""with k as (select company_id, created_at, company_id % 3 = 0 as has, nullif(array_to_string(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda t: t <> '' and t not in ({_quoted(identity.NAME_STOP)})), ''), '') as k from companies),
 h as (select distinct k from k where has), r as (select *, row_number() over (partition by k, has order by created_at, company_id) as n from k) select company_id, case when has or (n = 1 and k not in (select k from h where k is not null)) then k end as name_key from r""",
    ),
}


def _backfilled(companies):
    """Rows without a name key get theirs unless an existing one or an earlier row has it; a third have one already."""
    k = companies.withColumn("k", identity.company_name_key(F.col("name")))
    has = k.where("company_id % 3 = 0").select("k").distinct().withColumn("taken", F.lit(True))
    own = F.col("company_id") % 3 == 0
    rows = k.withColumn("own", own).withColumn("n", F.row_number().over(W.partitionBy(F.coalesce("k", F.concat(F.lit("\0"), F.col("company_id").cast("string"))), "own").orderBy("created_at", "company_id")))
    return rows.join(has, "k", "left").select("company_id", F.when(F.col("own") | ((F.col("n") == 1) & F.col("taken").isNull()), F.col("k")).alias("name_key"))
