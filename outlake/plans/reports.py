"""Registered queries over the outreach tables with their SQL, by SURVEY id: analytics, campaigns, pipeline, follow-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlake.operators import analytics, campaigns, followups, pipeline
from outlake.plans.views import AS_OF, load

STEPS = [7, 14, 30, 60]


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.sent_facts(*[load(spark, d, t) for t in ("emails", "contacts", "companies")])


def _board(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.board(load(spark, d, "contacts"), load(spark, d, "emails"))


def _emails(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "emails")


_SENT = "status = 'sent' and sent_at is not null"
_REPLIED = "cast(count_if(has_response and response_verified_at is not null) as bigint)"
_UNVERIFIED = "cast(count_if(has_response and response_verified_at is null) as bigint)"
_RATE = "round_even(replied / sent * 100, 1)"
_FACTS = f"""facts as (select e.*, ct.email_kind as contact_email_kind, ct.seniority_rank, ct.company_id as co_id, co.name as company_name
 from emails e left join contacts ct on ct.contact_id = e.contact_id left join companies co on co.company_id = ct.company_id
 where e.status = 'sent' and e.sent_at is not null)"""
_BAND = "case when seniority_rank <= 3 then 'executive' when seniority_rank <= 8 then 'lead' when seniority_rank <= 15 then 'individual' when seniority_rank is not null then 'other' end"
_RUNG = "case when follow_up_step > 0 then cast(follow_up_step as varchar) when is_follow_up then null else '0' end"
_FOLLOW = "(coalesce(is_follow_up, false) or original_email_id is not null)"
_AS_SENT = "(gmail_message_id is not null or sent_at is not null or status = 'sent')"
_EVIDENCE = "(coalesce(trim(gmail_message_id), '') <> '' or sent_at is not null)"

_SEGMENTS = f"""keys as (
 select 'email_type' as dimension, nullif(email_type, '') as key, nullif(email_type, '') as label, * from facts
 union all select 'email_kind', nullif(contact_email_kind, ''), nullif(contact_email_kind, ''), * from facts
 union all select 'seniority', {_BAND}, {_BAND}, * from facts
 union all select 'company', cast(co_id as varchar), coalesce(company_name, cast(co_id as varchar)), * from facts
 union all select 'written_by', case when used_template_fallback then 'template' else 'model' end, case when used_template_fallback then 'template' else 'model' end, * from facts
 union all select 'follow_up_step', {_RUNG}, {_RUNG}, * from facts),
g as (select dimension, key, min(label) as label, count(*) as sent, {_REPLIED} as replied, {_UNVERIFIED} as unverified from keys group by dimension, key),
segments as (select g.dimension, g.key, g.label, g.sent, g.replied, g.unverified, cast(coalesce(n.sent, 0) as bigint) as dropped, g.sent >= 10 as enough_data,
 case when g.sent >= 10 then round_even(g.replied / g.sent * 100, 1) end as rate
 from g left join g n on n.dimension = g.dimension and n.key is null where g.key is not null)"""

_EVIDENCED = f"""evidence as (select contact_id,
 cast(count_if(status in ('draft', 'approved') and scheduled_at is null and send_attempted_at is null and not {_EVIDENCE}) as bigint) as pending_draft_count,
 cast(count_if(scheduled_at is not null and status <> 'trashed' and not {_EVIDENCE}) as bigint) as queued_count,
 cast(count_if(not {_EVIDENCE} and send_attempted_at is not null and status <> 'trashed') as bigint) as unconfirmed_count,
 cast(count_if({_AS_SENT}) as bigint) as delivered_count,
 cast(count_if(bounced_at is not null and lower(coalesce(recipient_email, now)) = now) as bigint) as bounced_email_count,
 {_REPLIED} as verified_reply_count, {_UNVERIFIED} as unverified_reply_count,
 cast(count_if({_FOLLOW} and {_AS_SENT}) as bigint) as follow_up_count, max(sent_at) as last_sent_at
 from (select e.*, lower(coalesce(c.email, '')) as now from emails e join contacts c on c.contact_id = e.contact_id) group by contact_id),
board as (select c.*, coalesce(pending_draft_count, 0) as pending_draft_count, coalesce(queued_count, 0) as queued_count, coalesce(unconfirmed_count, 0) as unconfirmed_count,
 coalesce(delivered_count, 0) as delivered_count, coalesce(bounced_email_count, 0) as bounced_email_count, coalesce(verified_reply_count, 0) as verified_reply_count,
 coalesce(unverified_reply_count, 0) as unverified_reply_count, coalesce(follow_up_count, 0) as follow_up_count, last_sent_at,
 case when status = 'archived' then 'archived' when coalesce(verified_reply_count, 0) > 0 then 'replied' when bounced_at is not null or coalesce(bounced_email_count, 0) > 0 then 'bounced'
 when trim(coalesce(email, '')) = '' then 'no_address' when coalesce(pending_draft_count, 0) > 0 or coalesce(queued_count, 0) > 0 then 'drafted'
 when coalesce(delivered_count, 0) > 0 or coalesce(unconfirmed_count, 0) > 0 then 'awaiting' else 'ready' end as stage
 from contacts c left join evidence e on e.contact_id = c.contact_id),
drifting as (select *, case status when 'new' then 'ready' when 'drafted' then 'drafted' when 'sent' then 'awaiting' when 'replied' then 'replied' when 'archived' then 'archived' end
 not in (stage, case stage when 'no_address' then 'ready' when 'bounced' then 'awaiting' else stage end, case stage when 'no_address' then 'drafted' when 'bounced' then 'ready' else stage end,
 case stage when 'bounced' then 'drafted' else stage end) and not (stage = 'no_address' and false) as drift from board)"""

_FLAGS = f"""flags as (select e.contact_id,
 coalesce(bool_or({_FOLLOW} and e.status = 'sent' and e.sent_at is null), false) as undated_follow_up,
 coalesce(bool_or(has_response and response_verified_at is not null), false) as replied,
 coalesce(bool_or(has_response and response_verified_at is null), false) as reply_unverified,
 coalesce(bool_or(e.bounced_at is not null and lower(coalesce(recipient_email, c.email, '')) = lower(coalesce(c.email, ''))), false) as bounced_now,
 coalesce(bool_or({_FOLLOW} and e.status <> 'sent'), false) as unsent_follow_up,
 coalesce(bool_or({_FOLLOW} and e.status not in ('sent', 'trashed')), false) as follow_up_pending,
 cast(count_if(e.status = 'sent') as bigint) as n_sent, cast(count_if({_FOLLOW} and e.status = 'sent') as bigint) as follow_ups_sent
 from emails e left join contacts c on c.contact_id = e.contact_id where e.contact_id is not null group by e.contact_id)"""

_DUE = f"""{_FLAGS}, live as (select e.*, {_FOLLOW} as f from emails e join contacts c on c.contact_id = e.contact_id join flags g on g.contact_id = e.contact_id
 where e.status = 'sent' and e.sent_at is not null and c.bounced_at is null and c.follow_ups_declined_at is null
 and not (undated_follow_up or replied or bounced_now or unsent_follow_up)),
grouped as (select contact_id, cast(count_if(f) as bigint) as follow_ups_sent, max(sent_at) as last_touch_at from live group by contact_id),
anchors as (select contact_id, email_id from (select contact_id, email_id, row_number() over (partition by contact_id order by sent_at desc, email_id) as n
 from live where not f and not coalesce(has_response, false)) where n = 1),
due as (select g.contact_id, a.email_id, follow_ups_sent, follow_ups_sent + 1 as step, cast(4 as bigint) as steps_total, last_touch_at,
 cast(floor(date_diff('second', last_touch_at, {AS_OF}) / 86400) as bigint) as days_since_touch
 from grouped g join anchors a on a.contact_id = g.contact_id where follow_ups_sent < 4
 and last_touch_at < {AS_OF} - [7, 14, 30, 60][follow_ups_sent + 1] * interval '1' day)"""

_CAMPAIGN = f"""e as (select campaign_id, cast(count_if({_AS_SENT}) as bigint) as sent, cast(count_if(status in ('draft', 'approved') and not {_AS_SENT}) as bigint) as drafts,
 {_REPLIED} as replied, {_UNVERIFIED} as unverified, cast(count_if(bounced_at is not null) as bigint) as bounced, max(sent_at) as last_sent_at from emails group by campaign_id),
ct as (select campaign_id, count(*) as contacts from contacts group by campaign_id), co as (select campaign_id, count(*) as companies from companies group by campaign_id)"""
_CAMPAIGN_COLS = """coalesce(companies, 0) as companies, coalesce(contacts, 0) as contacts, coalesce(sent, 0) as sent, coalesce(drafts, 0) as drafts,
 coalesce(replied, 0) as replied, coalesce(unverified, 0) as unverified, coalesce(bounced, 0) as bounced, last_sent_at, coalesce(sent, 0) >= 10 as enough_data,
 case when coalesce(sent, 0) >= 10 then round_even(replied / sent * 100, 1) end as rate"""

_BEST = """ranked as (select *, row_number() over (order by rate desc, sent desc, label, key) as b, row_number() over (order by rate, sent, label desc, key desc) as w
 from segments where dimension = 'company' and enough_data)
select case when count(*) >= 2 then max(case when b = 1 then key end) end as best, case when count(*) >= 2 then max(case when w = 1 then key end) end as worst,
 case when count(*) >= 2 then round_even(max(rate) - min(rate), 1) end as spread from ranked"""


def _campaigns(spark: SparkSession, d: str) -> DataFrame:
    return campaigns.rollup(*[load(spark, d, t) for t in ("campaigns", "emails", "contacts", "companies")])


def _campaign_best(spark: SparkSession, d: str) -> DataFrame:
    c = _campaigns(spark, d).where("not archived").select(F.col("campaign_id").cast("string").alias("key"), F.col("name").alias("label"), "sent", "rate", "enough_data")
    return analytics.best_and_worst(c)


#: name -> (query, SQL over the views)
REPORTS = {
    "a1_segment_by_type": (
        lambda s, d: analytics.segment(analytics.dated(_emails(s, d)), F.col("email_type")),
        f"with {_FACTS}, {_SEGMENTS} select key, label, sent, replied, unverified, enough_data, rate, dropped from segments where dimension = 'email_type'",
    ),
    "a2_all_segments": (lambda s, d: analytics.all_segments(_facts(s, d)), f"with {_FACTS}, {_SEGMENTS} select * from segments"),
    "a3_a4_totals": (
        lambda s, d: analytics.totals(analytics.dated(_emails(s, d))),
        f"with {_FACTS}, t as (select count(*) as sent, {_REPLIED} as replied, {_UNVERIFIED} as unverified from facts) select *, sent >= 10 as enough_data, case when sent >= 10 then {_RATE} end as rate from t",
    ),
    "a5_hours_to_reply": (
        lambda s, d: analytics.hours_to_reply(analytics.dated(_emails(s, d))),
        f"""with {_FACTS}, h as (select round(date_diff('microsecond', sent_at, response_at) / 3.6e9, 2) as h from facts where has_response and response_verified_at is not null),
 g as (select h, row_number() over (order by h) - 1 as i, count(*) over () as n from h where h >= 0),
 ranks as (select max(n) as n, max(case when i = floor(0.5 * (n - 1) + 0.5) then h end) as median, max(case when i = floor(0.25 * (n - 1) + 0.5) then h end) as p25,
 max(case when i = floor(0.75 * (n - 1) + 0.5) then h end) as p75, min(h) as fastest, max(h) as slowest from g)
 select cast(coalesce(n, 0) as bigint) as count, median, p25, p75, fastest, slowest, cast((select count(*) from h) - coalesce(n, 0) as bigint) as excluded from ranks""",
    ),
    "a6_best_and_worst_company": (
        lambda s, d: analytics.best_and_worst(analytics.segment(_facts(s, d), F.col("co_id").cast("string"), F.coalesce("company_name", F.col("co_id").cast("string")))),
        f"with {_FACTS}, {_SEGMENTS}, {_BEST}",
    ),
    "a7_a8_campaign_rollup": (_campaigns, f"with {_CAMPAIGN} select c.campaign_id, c.name, c.archived, {_CAMPAIGN_COLS} from campaigns c left join e using (campaign_id) left join ct using (campaign_id) left join co using (campaign_id)"),
    "a9_campaign_best_and_worst": (
        _campaign_best,
        f"""with {_CAMPAIGN}, segments as (select 'company' as dimension, cast(c.campaign_id as varchar) as key, c.name as label, {_CAMPAIGN_COLS} from campaigns c left join e using (campaign_id)
 left join ct using (campaign_id) left join co using (campaign_id) where not c.archived), {_BEST}""",
    ),
    "a10_unassigned_campaign": (
        lambda s, d: campaigns.unassigned(*[load(s, d, t) for t in ("emails", "contacts", "companies")]),
        f"with {_CAMPAIGN} select {_CAMPAIGN_COLS} from (select 1) left join e on e.campaign_id is null left join ct on ct.campaign_id is null left join co on co.campaign_id is null",
    ),
    "a11_dashboard": (
        lambda s, d: analytics.dashboard(*[load(s, d, t) for t in ("emails", "contacts", "companies")]),
        """with t as (select cast(count_if(status in ('draft', 'approved')) as bigint) as drafts, cast(count_if(status = 'sent') as bigint) as sent,
 cast(count_if(status = 'sent' and has_response and response_verified_at is not null) as bigint) as replied,
 cast(count_if(status = 'sent' and has_response and response_verified_at is null) as bigint) as unverified from emails)
 select *, (select count(*) from contacts) as contacts, (select count(*) from companies) as companies, coalesce(case when sent > 0 then round_even(replied / sent * 100, 1) end, 0.0) as reply_rate from t""",
    ),
    "a12_timeline": (
        lambda s, d: analytics.timeline(_emails(s, d), AS_OF, 30),
        f"""with days as (select cast({AS_OF} as date) - cast(i as integer) as day from range(30) t(i)),
 s as (select cast(sent_at as date) as day, count(*) as n from emails where status = 'sent' and sent_at is not null group by 1),
 r as (select cast(response_at as date) as day, count(*) as n from emails where has_response and response_verified_at is not null group by 1)
 select days.day, coalesce(s.n, 0) as sent, coalesce(r.n, 0) as replies from days left join s on s.day = days.day left join r on r.day = days.day""",
    ),
    "a13_by_type": (
        lambda s, d: analytics.by_type(_emails(s, d)),
        """select email_type, count(*) as total, cast(count_if(status = 'sent') as bigint) as sent, cast(count_if(status = 'sent' and has_response and response_verified_at is not null) as bigint) as replied,
 cast(count_if(status = 'sent' and has_response and response_verified_at is null) as bigint) as unverified from emails where status <> 'trashed' group by email_type""",
    ),
    "a14_company_counts": (
        lambda s, d: pipeline.company_counts(*[load(s, d, t) for t in ("companies", "contacts", "emails")]),
        f"""with k as (select ct.company_id, count(distinct ct.contact_id) as contacts, cast(count_if(e.status = 'sent') as bigint) as sent,
 cast(count_if(e.has_response and e.response_verified_at is not null) as bigint) as replied, cast(count_if(e.has_response and e.response_verified_at is null) as bigint) as unverified
 from contacts ct left join emails e on e.contact_id = ct.contact_id group by ct.company_id)
 select c.company_id, c.name, coalesce(contacts, 0) as contacts, coalesce(sent, 0) as sent, coalesce(replied, 0) as replied, coalesce(unverified, 0) as unverified
 from companies c left join k on k.company_id = c.company_id""",
    ),
    "a15_contact_counts": (
        lambda s, d: pipeline.contact_counts(load(s, d, "contacts"), _emails(s, d)),
        f"""with k as (select contact_id, count(*) as emails, max(sent_at) as last_sent_at, {_REPLIED} as replied, {_UNVERIFIED} as unverified from emails group by contact_id)
 select c.contact_id, coalesce(emails, 0) as emails, last_sent_at, coalesce(replied, 0) as replied, coalesce(unverified, 0) as unverified from contacts c left join k using (contact_id)""",
    ),
    "a16_f25_f26_board": (
        lambda s, d: _board(s, d).select("contact_id", "stage", "drift", "pending_draft_count", "queued_count", "unconfirmed_count", "delivered_count", "bounced_email_count", "verified_reply_count", "unverified_reply_count", "follow_up_count", "last_sent_at"),
        f"with {_EVIDENCED} select contact_id, stage, drift, pending_draft_count, queued_count, unconfirmed_count, delivered_count, bounced_email_count, verified_reply_count, unverified_reply_count, follow_up_count, last_sent_at from drifting",
    ),
    "a17_board_totals": (
        lambda s, d: pipeline.board_totals(_board(s, d)),
        f"""with {_EVIDENCED}, t as (select stage, count(*) as total, cast(count_if(drift) as bigint) as drifted, cast(sum(queued_count) as bigint) as queued,
 cast(count_if(stage = 'ready' or (stage = 'drafted' and pending_draft_count > 0)) as bigint) as waiting_on_you from drifting group by stage)
 select s.stage, coalesce(total, 0) as total, coalesce(drifted, 0) as drifted, coalesce(queued, 0) as queued, coalesce(waiting_on_you, 0) as waiting_on_you, greatest(0, coalesce(total, 0) - 100) as hidden
 from (select unnest(['ready', 'drafted', 'awaiting', 'replied', 'bounced', 'no_address', 'archived']) as stage) s left join t using (stage)""",
    ),
    "a18_batch_stamped_minutes": (
        lambda s, d: analytics.batch_stamped(_emails(s, d)),
        "select date_trunc('minute', response_at) as minute, count(*) as n from emails where response_at is not null group by 1 having count(*) >= 3",
    ),
    "j16_batch_stamped_replies": (
        lambda s, d: analytics.batch_stamped_rows(_emails(s, d)),
        """select email_id, response_at from emails where date_trunc('minute', response_at) in
 (select date_trunc('minute', response_at) from emails where response_at is not null group by 1 having count(*) >= 3)""",
    ),
    "w6_f27_board_cards": (
        lambda s, d: pipeline.cards(_board(s, d)),
        f"""with {_EVIDENCED}, r as (select *, row_number() over (partition by stage order by last_sent_at desc nulls last, lower(name), contact_id) as place from board)
 select stage, place, contact_id, coalesce(nullif(name, ''), nullif(email, ''), 'Unnamed contact') as name, unverified_reply_count > 0 and verified_reply_count = 0 as reply_unverified,
 pending_draft_count > 0 and trim(coalesce(email, '')) = '' as blocked_draft from r where place <= 100""",
    ),
    "j1_decorated_emails": (
        lambda s, d: pipeline.decorated(*[load(s, d, t) for t in ("emails", "contacts", "companies")]),
        """select e.email_id, coalesce(e.recipient_email, c.email) as recipient, c.name as contact_name, co.name as company_name from emails e
 left join contacts c on c.contact_id = e.contact_id left join companies co on co.company_id = c.company_id""",
    ),
    "j2_analytics_facts": (
        lambda s, d: _facts(s, d).select("email_id", "contact_email_kind", "seniority_rank", "company_name"),
        f"with {_FACTS} select email_id, contact_email_kind, seniority_rank, company_name from facts",
    ),
    "j4_has_follow_up": (
        lambda s, d: followups.has_follow_up(_emails(s, d)),
        f"""select o.email_id, exists (select 1 from emails f where {_FOLLOW.replace('is_follow_up', 'f.is_follow_up').replace('original_email_id', 'f.original_email_id')} and f.status <> 'trashed' and f.original_email_id = o.email_id)
 or exists (select 1 from emails f where {_FOLLOW.replace('is_follow_up', 'f.is_follow_up').replace('original_email_id', 'f.original_email_id')} and f.status <> 'trashed' and f.contact_id = o.contact_id) as has_follow_up from emails o""",
    ),
    "j5_contact_flags": (
        lambda s, d: followups.contact_flags(_emails(s, d), load(s, d, "contacts")).drop("previous_email_id"),
        f"with {_FLAGS} select * from flags",
    ),
    "j6_w4_o9_due_follow_ups": (
        lambda s, d: followups.due(_emails(s, d), load(s, d, "contacts"), STEPS, AS_OF),
        f"with {_DUE} select * from due",
    ),
    "a28_due_by_step": (
        lambda s, d: followups.due(_emails(s, d), load(s, d, "contacts"), STEPS, AS_OF).groupBy("step").agg(F.count("*").alias("n")),
        f"with {_DUE} select step, count(*) as n from due group by step",
    ),
    "j12_thread_roots": (
        lambda s, d: followups.roots(_emails(s, d)),
        """with recursive emails_ as materialized (select email_id, case when coalesce(is_follow_up, false) or original_email_id is not null then original_email_id end as parent from emails),
 up as (select email_id, email_id as root_id, 0 as n from emails_ union all select up.email_id, e.parent, n + 1 from up join emails_ e on e.email_id = up.root_id join emails_ p on p.email_id = e.parent where n < 10)
 select email_id, arg_max(root_id, n) as root_id from up group by email_id""",
    ),
    "p6_delivered_predicates": (
        lambda s, d: _emails(s, d).select("email_id", pipeline.has_evidence().alias("a"), pipeline.counts_as_sent().alias("b"), pipeline.may_have_left().alias("c"), pipeline.attempt_pending().alias("pending")),
        f"select email_id, {_EVIDENCE} as a, {_AS_SENT} as b, (status = 'sent' or gmail_message_id is not null or send_attempted_at is not null) as c, not {_EVIDENCE} and send_attempted_at is not null as pending from emails",
    ),
    "p5_mailbox_tabs": (
        lambda s, d: pipeline.tabs(_emails(s, d)),
        f"""select email_id, case when status = 'trashed' then 'trashed' when scheduled_at is not null and not {_EVIDENCE} then 'queued' when status = 'sent' or {_EVIDENCE} then 'sent'
 when status in ('draft', 'approved') then 'drafts' end as tab from emails""",
    ),
    "p8_sent_window": (
        lambda s, d: _emails(s, d).where(f"status = 'sent' and sent_at >= {AS_OF} - interval '90' day").select("email_id", "sent_at"),
        f"select email_id, sent_at from emails where status = 'sent' and sent_at >= {AS_OF} - interval '90' day",
    ),
    "p9_reply_check_list": (
        lambda s, d: _emails(s, d).where("status = 'sent' and gmail_message_id is not null and (not has_response or response_verified_at is null)").orderBy(F.desc_nulls_last("sent_at"), "email_id").limit(200).select("email_id", "sent_at"),
        "select email_id, sent_at from emails where status = 'sent' and gmail_message_id is not null and (not has_response or response_verified_at is null) order by sent_at desc nulls last, email_id limit 200",
    ),
    "a27_queue_summary": (
        lambda s, d: _emails(s, d).where("scheduled_at is not null").where(~pipeline.has_evidence()).where("status <> 'trashed'").agg(F.count("*").alias("queued"), F.min("scheduled_at").alias("first_at")),
        f"select count(*) as queued, min(scheduled_at) as first_at from emails where scheduled_at is not null and not {_EVIDENCE} and status <> 'trashed'",
    ),
}
for _manual in (False, True):
    _unsent = "follow_up_pending" if _manual else "unsent_follow_up"
    REPORTS[f"g3_follow_up_plan_{'manual' if _manual else 'auto'}"] = (
        lambda s, d, m=_manual: followups.plan(load(s, d, "contacts"), _emails(s, d), load(s, d, "suppressions"), STEPS, m).drop("previous_email_id"),
        "with " + _FLAGS + ", "
        # fmt: off
        """chain as (select contact_id, regexp_replace(lower(trim(email)), '^.*@', '') as d, lower(trim(email)) as e from contacts where trim(coalesce(email, '')) <> ''),
 blocked as (select distinct c.contact_id from chain c join suppressions s on (s.kind = 'domain' and (c.d = s.value or ends_with(c.d, '.' || s.value)))
   or (s.kind = 'address' and regexp_replace(c.e, '\\+[^@]*@', '@') = regexp_replace(lower(s.value), '\\+[^@]*@', '@'))),
 r as (select c.contact_id, case when coalesce(replied, false) then 'replied' when c.bounced_at is not null or coalesce(bounced_now, false) then 'bounced' when b.contact_id is not null then 'suppressed'
 """ + ("" if _manual else "when c.follow_ups_declined_at is not null then 'declined' ") + f"""when coalesce({_unsent}, false) then 'already drafted'
 when coalesce(n_sent, 0) = 0 then 'nothing sent' when coalesce(follow_ups_sent, 0) >= 4 then 'cadence finished' end as refusal, follow_ups_sent
 from contacts c left join flags f on f.contact_id = c.contact_id left join blocked b on b.contact_id = c.contact_id)
 select contact_id, refusal, case when refusal is null then follow_ups_sent + 1 end as step from r""",
        # fmt: on
    )
