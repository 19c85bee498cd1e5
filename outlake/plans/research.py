"""Registered queries: research history, replies, ingest and entity resolution, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlake.functions import identity, people, text
from outlake.operators import ingest, replies, research
from outlake.plans.entities import _MATCH, _quoted
from outlake.plans.people import CLASSED, PARTS, classed, known
from outlake.plans.views import load

_SQZ = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_RUNS = f"""rn as (select *, nullif({_SQZ.format('criteria')}, '') as label from runs),
 bl as (select company_id, run_id, label, unnest(['changes', 'changes', 'policies']) as category, unnest([0, 1, 2]) as place, unnest([{_SQZ.format('bullet_1')}, {_SQZ.format('bullet_2')}, {_SQZ.format('bullet_3')}]) as text from rn)"""
_KEPT = """kr as (select * from (select *, row_number() over (partition by company_id, coalesce(job_id, 'run:' || run_id) order by run_id desc) as n from runs) where n = 1),
 kept as (select * from (select * exclude (n), row_number() over (partition by company_id order by run_id desc) as m from kr) where m <= 10)"""
_TERMS = r"""tm as (select contact_id, company_id, address, profile, list_filter(list_transform(string_split(regexp_extract(trim(regexp_replace(coalesce(notes, ''), '\s+', ' ', 'g')), '(?i)criteria match:\s*([^;]+)', 1), ','), lambda x: trim(x)), lambda x: x <> '') as t,
 regexp_matches(coalesce(notes, ''), '(?i)\bcriteria\s+match\b') as hit from people)"""
_THREADS = """th as (select thread_id, count(*) as messages, cast(count_if(not sent_label and class = 'reply') as bigint) as reply_count, cast(count_if(not sent_label and class = 'bounce') as bigint) as bounce_count,
 max(case when not sent_label and class = 'reply' then internal_ms end) as replied_ms, max(case when not sent_label and class = 'bounce' then internal_ms end) as bounced_ms from cl group by thread_id)"""
_CHECK = f"""{CLASSED}, {_THREADS}, ck as (select e.*, case when t.thread_id is null then null when reply_count > 0 then 'reply' else 'none' end as verdict, coalesce(bounce_count > 0, false) and e.bounced_at is null as bounced_now
  from emails e left join th t on t.thread_id = e.email_id where e.status = 'sent'),
 oc as (select *, case when verdict is null then 'failed' when verdict = 'reply' and not has_response then 'new' when verdict = 'reply' and response_verified_at is null then 'confirmed' when verdict = 'reply' then 'kept' when has_response then 'cleared' else 'none' end as outcome from ck)"""


def _threads(s, d):
    return replies.thread_verdicts(classed(load(s, d, "headers")))


def _checked(s, d):
    v = _threads(s, d).select(F.col("thread_id").alias("email_id"), F.when(F.col("reply_count") > 0, "reply").otherwise("none").alias("verdict"), (F.col("bounce_count") > 0).alias("bounced"))
    return replies.checked(load(s, d, "emails").where("status = 'sent'"), v)


def _candidates(s, d):
    """Each person once more, wanted by the next company."""
    p = load(s, d, "people")
    return p.select(F.col("contact_id").alias("candidate_id"), (F.col("company_id") + 1 - F.col("contact_id") % 2).alias("company_id"), "company", "address", "profile", "person", known().alias("known"))


def _wanted(s, d):
    """Companies under other names and domains than the stored ones."""
    c = load(s, d, "companies")
    k = F.col("company_id") % 6
    name = F.when(k == 0, F.upper("name")).when(k == 2, F.concat("name", F.lit(" Technologies"))).otherwise(F.concat(F.lit("New "), F.col("name")))
    domain = F.when(F.col("company_id") % 4 == 0, F.col("domain")).when(F.col("company_id") % 10 == 2, "other.example.org")
    return c.select(F.col("company_id").alias("wanted_id"), name.alias("name"), domain.alias("domain"))


_WANTED = """wt as (select company_id as wanted_id, case company_id % 6 when 0 then upper(name) when 2 then name || ' Technologies' else 'New ' || name end as name,
 case when company_id % 4 = 0 then domain when company_id % 10 = 2 then 'other.example.org' end as domain from companies)"""


def _key(x: str) -> str:
    return f"nullif(array_to_string(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '' and t not in ({_quoted(identity.NAME_STOP)})), ''), '')"


_HELD = f"""ce as (select contact_id as candidate_id, company_id + 1 - contact_id % 2 as wants, company, address, lower(trim(address)) as e, profile,
   nullif(regexp_replace(regexp_replace(trim(profile), '/+$', ''), '(?i)^https?://(www\\.)?linkedin\\.com', 'https://www.linkedin.com'), '') as u, contact_id, company_id from people),
 he as (select e, min((contact_id, company_id)) as x from ce where e <> '' group by e), hu as (select u, min((contact_id, company_id)) as x from ce where u is not null group by u),
 held as (select candidate_id, wants, company, address, profile, coalesce(he.x, hu.x)[1] as contact_id, coalesce(he.x, hu.x)[2] as company_id from ce left join he on he.e = ce.e and ce.e <> '' left join hu on hu.u = ce.u)"""
_OLDEST = "(select {0} as key, arg_min(company_id, (created_at, company_id)) as company_id from companies where coalesce({0}, '') <> '' group by 1)"
_OLDEST_ROW = "(select {0} as key, arg_min({{'company_id': company_id, 'domain': nullif(lower(domain), ''), 'name': lower(trim(name))}}, (created_at, company_id)) as x from companies where coalesce({0}, '') <> '' group by 1)"
_CANDIDATE_KEY = "case when u is not null then 'li:' || u when e <> '' then 'em:' || e when low <> '' then concat_ws('|', 'nm:' || low, lower(trim(title)), lower(trim(src))) else 'id:' || candidate_id end"

RESEARCH = {
    "w8_kept_runs": (
        lambda s, d: research.kept_runs(load(s, d, "runs")).select("company_id", "run_id"),
        f"with {_KEPT} select company_id, run_id from kept",
    ),
    "a21_consolidated_research": (
        lambda s, d: research.consolidated(load(s, d, "companies"), research.kept_runs(load(s, d, "runs"))).select(
            "company_id", "run_count", "first_researched_at", "last_researched_at", "employee_estimate", F.array_join("criteria", "|").alias("criteria"), F.array_join("news", "|").alias("news")
        ),
        f"""with {_KEPT}, g as (select company_id, count(*) as run_count, min(researched_at) as first_researched_at, max(researched_at) as last_researched_at, arg_max(employee_estimate, run_id) filter (where employee_estimate is not null) as employee_estimate from kept group by 1),
 l as (select company_id, {_SQZ.format('criteria')} as label, min(run_id) as o from kept where {_SQZ.format('criteria')} <> '' group by 1, 2), c as (select company_id, string_agg(label, '|' order by o, label) as criteria from l group by 1),
 nk as (select company_id, {_NORM.format('news')} as key, min(run_id) as o, arg_min(news, run_id) as text from kept group by 1, 2), nr as (select *, row_number() over (partition by company_id order by o, text) as r from nk), n as (select company_id, string_agg(text, '|' order by o, text) as news from nr where r <= 10 group by 1)
 select co.company_id, coalesce(run_count, 0) as run_count, first_researched_at, last_researched_at, employee_estimate, coalesce(criteria, '') as criteria, coalesce(news, '') as news
 from companies co left join g using (company_id) left join c using (company_id) left join n using (company_id)""",
    ),
    "o6_research_order": (
        lambda s, d: research.consolidated(load(s, d, "companies"), load(s, d, "runs")).orderBy(*research.in_report_order()).select("company_id", "run_count"),
        """select co.company_id, coalesce(n, 0) as run_count from companies co left join (select company_id, count(*) as n, max(researched_at) as last from runs group by 1) g on g.company_id = co.company_id
 order by coalesce(n, 0) > 0 desc, last desc nulls last, name, co.company_id""",
    ),
    "a22_merged_bullets": (
        lambda s, d: research.merged_bullets(research.bullets(load(s, d, "runs"))).select("company_id", "category", "text", F.array_join("criteria", "|").alias("criteria")),
        f"""with {_RUNS}, k as (select *, {_NORM.format('text')} as key from bl), t as (select company_id, category, key, arg_min(text, (run_id, place)) as text from k group by 1, 2, 3),
 l as (select company_id, category, key, label, min((run_id, place)) as o from k where label is not null group by 1, 2, 3, 4), c as (select company_id, category, key, string_agg(label, '|' order by o, label) as criteria from l group by 1, 2, 3)
 select company_id, category, text, coalesce(criteria, '') as criteria from t left join c using (company_id, category, key)""",
    ),
    "a24_bullets_per_run": (
        lambda s, d: research.bullets_per_run(research.bullets(load(s, d, "runs")).where("text <> ''")),
        f"with {_RUNS} select run_id, count(*) as n from bl where text <> '' group by 1",
    ),
    "u8_latest_bullets": (
        lambda s, d: research.latest_bullets(research.bullets(load(s, d, "runs"))),
        f"""with {_RUNS}, oo as (select company_id, category, text, min((-run_id, place)) as o from bl group by 1, 2, 3), r as (select *, row_number() over (partition by company_id, category order by o, text) as place from oo)
 select company_id, category, place, text from r where place <= 8""",
    ),
    "a23_contacts_by_criteria": (
        lambda s, d: research.by_criteria(load(s, d, "people")),
        f"""with {_TERMS}, s as (select *, case when len(t) > 0 then t when hit then ['Criteria match'] else [null] end as sh from tm), l as (select company_id, contact_id, unnest(sh) as term, unnest(range(0, len(sh))) as place from s),
 f as (select company_id, lower(term) as key, arg_min(term, (contact_id, place)) as label from l where term is not null group by 1, 2)
 select distinct l.company_id, f.label as term, contact_id from l left join f on f.company_id is not distinct from l.company_id and f.key = lower(l.term)""",
    ),
    "a23_criteria_totals": (
        lambda s, d: research.criteria_totals(load(s, d, "people")),
        f"""with {_TERMS} select company_id, count(*) as total, cast(count_if(trim(address) <> '') as bigint) as with_email, cast(count_if(coalesce(profile, '') <> '') as bigint) as with_profile, cast(count_if(len(t) > 0 or hit) as bigint) as matched from tm group by 1""",
    ),
    "a32_research_quality": (
        lambda s, d: load(s, d, "companies").join(load(s, d, "runs").groupBy("company_id").agg(F.count("*").alias("pages"), F.max_by("bullet_1", "run_id").alias("summary")), "company_id", "left")
        .join(load(s, d, "people").groupBy("company_id").agg(F.bool_or((F.col("person") != "") | (F.coalesce("title", F.lit("")) != "")).alias("someone")), "company_id", "left")
        .select("company_id", research.quality_tier(F.col("summary"), F.coalesce("pages", F.lit(0)), F.coalesce("someone", F.lit(False))).alias("tier")),
        """select c.company_id, case when n >= 4 and coalesce(p.someone, false) then 'high' when n >= 2 then 'medium' else 'low' end as tier from companies c left join (select company_id, count(*) as n from runs group by 1) r on r.company_id = c.company_id
 left join (select company_id, bool_or(person <> '' or title <> '') as someone from people group by 1) p on p.company_id = c.company_id""",
    ),
    "s7_company_pages": (
        lambda s, d: research.company_pages(load(s, d, "pages").withColumn("site", identity.registered_domain(F.col("url"))), "site", text.visible_text(F.col("html")), "page_id").select("site", "pages", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest")),
        r"""with p as (select page_id, array_to_string(string_split(regexp_extract(lower(trim(url)), '//([^/?#]*)', 1), '.')[-2:], '.') as site,
  substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 5000) as t from pages),
 f as (select *, coalesce(sum(length(t) + 2) over (partition by site order by page_id rows between unbounded preceding and 1 preceding), 0) as ahead from p where length(t) > 80), g as (select site, count(*) as pages, substr(string_agg(t, chr(10) || chr(10) order by page_id), 1, 24000) as t from f where ahead < 24000 group by site)
 select site, pages, length(t) as chars, md5(t) as digest from g""",
    ),
    "w10_thread_verdicts": (
        lambda s, d: _threads(s, d).select("thread_id", "verdict", "replied_ms", "bounced_ms"),
        f"with {CLASSED}, {_THREADS} select thread_id, case when reply_count > 0 then 'reply' when bounce_count > 0 then 'bounce' else 'none' end as verdict, replied_ms, bounced_ms from th",
    ),
    "a31_thread_counters": (
        lambda s, d: replies.thread_counters(classed(load(s, d, "headers")), load(s, d, "emails").withColumn("thread_id", F.col("email_id")), 3),
        f"""with {CLASSED}, {_THREADS} select email_id, reply_count, bounce_count, greatest(0, messages - 3) as older_omitted, reply_count > 0 and not has_response as unrecorded_reply, bounce_count > 0 and bounced_at is null as unrecorded_bounce
 from emails join th on th.thread_id = emails.email_id""",
    ),
    "a29_check_counters": (
        lambda s, d: replies.check_counters(_checked(s, d)),
        f"""with {_CHECK} select count(*) as checked, cast(count_if(outcome = 'new') as bigint) as new_replies, cast(count_if(outcome = 'confirmed') as bigint) as confirmed, cast(count_if(outcome = 'cleared') as bigint) as cleared, cast(count_if(outcome = 'failed') as bigint) as failed_checks,
 cast(count_if(bounced_now) as bigint) as bounced, cast(count_if(case outcome when 'new' then false when 'confirmed' then false when 'kept' then false when 'cleared' then false else has_response and response_verified_at is null end) as bigint) as unverified_remaining from oc""",
    ),
    "t5_checked_emails": (
        lambda s, d: _checked(s, d).select("email_id", "outcome", "bounced_now", "has_response_after", "verified_after"),
        f"""with {_CHECK} select email_id, outcome, bounced_now, case outcome when 'new' then true when 'cleared' then false else has_response end as has_response_after,
 case when outcome in ('new', 'confirmed', 'kept') then true when outcome = 'cleared' then false else response_verified_at is not null end as verified_after from oc""",
    ),
    "t5_folded_states": (
        lambda s, d: replies.folded_states(load(s, d, "verdicts")),
        """select email_id, coalesce(arg_max(verdict, (checked_at, verdict_no)) filter (where verdict in ('reply', 'none')) = 'reply', false) as has_response, min(checked_at) filter (where verdict = 'bounce') as bounced_at from verdicts group by 1""",
    ),
    "g1_ingest_gate": (
        lambda s, d: ingest.gate(load(s, d, "people"), load(s, d, "suppressions")),
        _GATE := f"""with {PARTS}, {_MATCH.replace('from contacts', 'from (select contact_id, address as email from people)')},
 gt as (select k.*, trim(address) as em, coalesce(trim(profile), '') as url, p.contact_id is not null as blocked from pd k left join (select * from picked where n = 1) p on p.contact_id = k.contact_id),
 gk as (select *, case when generic and url <> '' and person <> '' and slug_match then '' else em end as left_em from gt),
 gd as (select contact_id, url, person, slug_match, case when em <> '' and not regexp_full_match(em, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(\\.[A-Za-z0-9\\-]+)+') then 'invalid_email' when em <> '' and blocked then 'suppressed'
  when url <> '' and not regexp_matches(url, '(?i)^https://(www\\.)?linkedin\\.com/in/') then 'invalid_linkedin_url' when generic and left_em <> '' then 'company_or_role_inbox' when url <> '' and person = '' then 'linkedin_needs_name'
  when left_em = '' and not (url <> '' and slug_match) then 'no_usable_contact_method' when left_em <> '' and person <> '' and not name_match and not (url <> '' and slug_match) then 'email_does_not_match_name'
  when left_em <> '' and person = '' then 'name_required_for_email' when left_em = '' or not name_match then 'accept_profile_only' else 'accept' end as decision from gk),
 gw as (select contact_id, decision, case when decision like 'accept%' and url <> '' and person <> '' and not slug_match then 'linkedin_does_not_match_name' end as warning from gd)
 select contact_id, decision, warning from gw""",
    ),
    "a30_import_counters": (
        lambda s, d: ingest.import_counters(ingest.gate(load(s, d, "people"), load(s, d, "suppressions"))),
        _GATE.replace(
            " select contact_id, decision, warning from gw",
            """, r as (select *, row_number() over (partition by decision order by contact_id) as n from gw)
 select decision, count(*) as n, count(warning) as warnings, coalesce(string_agg(cast(contact_id as varchar), ',' order by contact_id) filter (where n <= 5 and decision not like 'accept%'), '') as samples from r group by 1""",
        ),
    ),
    "j10_contact_lookup": (
        lambda s, d: ingest.existing(_candidates(s, d), load(s, d, "people")),
        f"with {_HELD} select candidate_id, contact_id, company_id from held",
    ),
    "u10_inserted": (
        lambda s, d: ingest.inserted(_candidates(s, d).withColumn("address", F.when(F.col("candidate_id") % 5 == 0, F.concat(F.lit("new."), F.trim("address"))).otherwise(F.col("address"))).withColumn("profile", F.lit("")), load(s, d, "people")),
        f"""with {_HELD}, nw as (select candidate_id, case when candidate_id % 5 = 0 then lower('new.' || trim(address)) else lower(trim(address)) end as e from ce)
 select nw.candidate_id, he.x[1] as contact_id, he.x is null as inserted from nw left join he on he.e = nw.e""",
    ),
    "j21_identifier_conflicts": (
        lambda s, d: ingest.conflicts(_candidates(s, d), load(s, d, "people"), load(s, d, "companies")),
        f"""with {_HELD} select candidate_id, contact_id, concat(coalesce(nullif(trim(address), ''), profile), ' already belongs to ', coalesce(o.name, 'another company'), ' — not reassigned to ', coalesce(company, 'this company')) as note
 from held h left join companies o on o.company_id = h.company_id where contact_id is not null and (h.company_id is null or h.company_id <> wants)""",
    ),
    "g6_attached_candidates": (
        lambda s, d: ingest.attached(_candidates(s, d), load(s, d, "people")),
        f"""with {PARTS}, cx as (select contact_id as candidate_id, company_id + 1 - contact_id % 2 as wants, case when e = '' or kind = 'generic' or (person <> '' and not person_match and not email_verified) then '' else trim(address) end as address,
   case when profile_verified then profile else '' end as profile from known),
 cy as (select *, lower(address) as e, nullif(regexp_replace(regexp_replace(profile, '/+$', ''), '(?i)^https?://(www\\.)?linkedin\\.com', 'https://www.linkedin.com'), '') as u from cx),
 pp as (select contact_id, company_id, lower(trim(address)) as e, nullif(regexp_replace(regexp_replace(trim(profile), '/+$', ''), '(?i)^https?://(www\\.)?linkedin\\.com', 'https://www.linkedin.com'), '') as u from people),
 he as (select e, min((contact_id, company_id)) as x from pp where e <> '' group by e), hu as (select u, min((contact_id, company_id)) as x from pp where u is not null group by u),
 az as (select cy.*, coalesce(he.x, hu.x) as x from cy left join he on he.e = cy.e and cy.e <> '' left join hu on hu.u = cy.u),
 ac as (select *, case when address = '' and profile = '' then 'nothing' when x is null then 'attach' when x[2] is not distinct from wants then 'enrich' else 'conflict' end as action from az)
 select candidate_id, action, action = 'attach' and address <> '' as email_lands, action = 'attach' and profile <> '' as profile_lands from ac""",
    ),
    "w12_o8_top_people": (
        lambda s, d: ingest.top_people(load(s, d, "people").withColumn("known", known()), 3),
        f"""with {PARTS}, r as (select *, row_number() over (partition by company_id order by not person_verified, not email_verified, not profile_verified, kind <> 'personal', coalesce(seniority_rank, 20), not on_domain, lower(coalesce(nullif(trim(address), ''), profile, '')), contact_id) as place
 from known where person <> '' and not name_from_email and (person_verified or profile_verified or (person_match and kind = 'personal'))) select company_id, place, contact_id from r where place <= 3""",
    ),
    "w9_best_per_email": (
        lambda s, d: ingest.best_per_email(load(s, d, "people").withColumn("candidate_id", F.col("contact_id")).withColumn("school_match", F.col("contact_id") % 7 == 0)),
        """select email, candidate_id from (select lower(trim(address)) as email, contact_id as candidate_id, row_number() over (partition by lower(trim(address)) order by contact_id % 7 <> 0, coalesce(seniority_rank, 20), person = '', contact_id) as n from people where trim(address) <> '') where n = 1""",
    ),
    "w13_persistable_people": (
        lambda s, d: ingest.persistable(load(s, d, "people").select("company_id", "contact_id", people.is_noted_match(F.col("notes")).alias("matched"), F.size(people.noted_terms(F.col("notes"))).alias("score"), "seniority_rank"), 5, 4, 2),
        f"""with {_TERMS}, p as (select tm.company_id, tm.contact_id, hit as matched, len(t) as score, seniority_rank from tm join contacts using (contact_id)), r as (select *, row_number() over (partition by company_id, matched order by score desc, coalesce(seniority_rank, 20), contact_id) as place,
 least(4, sum(case when matched then 1 else 0 end) over (partition by company_id)) as m from p) select company_id, contact_id, matched, place from r where place <= case when matched then 4 else greatest(0, 5 - m) + 2 end""",
    ),
    "j11_company_lookup": (
        lambda s, d: ingest.company_lookup(_wanted(s, d), load(s, d, "companies")),
        f"""with {_WANTED}, by_n as {_OLDEST.format('lower(trim(name))')}, by_k as {_OLDEST.format(_key('name'))}, by_d as {_OLDEST.format('lower(trim(domain))')}
 select wanted_id, coalesce(n.company_id, k.company_id, d.company_id) as company_id, case when n.company_id is not null then 'name' when k.company_id is not null then 'name_key' when d.company_id is not null then 'domain' end as found_by
 from wt left join by_n n on n.key = lower(trim(wt.name)) left join by_k k on k.key = {_key('wt.name')} left join by_d d on d.key = lower(trim(wt.domain))""",
    ),
    "u4_insert_or_match": (
        lambda s, d: ingest.insert_or_match(_wanted(s, d), load(s, d, "companies")),
        f"""with {_WANTED}, by_n as {_OLDEST_ROW.format('lower(trim(name))')}, by_k as {_OLDEST_ROW.format(_key('name'))}, by_d as {_OLDEST_ROW.format('lower(trim(domain))')},
 j as (select wanted_id, lower(trim(wt.name)) as n, {_key('wt.name')} as k, nullif(lower(trim(wt.domain)), '') as d, bn.x as bn, bk.x as bk, bd.x as bd
  from wt left join by_n bn on bn.key = lower(trim(wt.name)) left join by_k bk on bk.key = {_key('wt.name')} left join by_d bd on bd.key = lower(trim(wt.domain))),
 a as (select *, case when bd is not null then 'match_domain' when bn is not null and bn.domain is not distinct from d then 'match_name' when bk is not null and d is not null and bk.domain is null and bk.name = n then 'claim' else 'insert' end as action from j)
 select wanted_id, action, case action when 'match_domain' then bd.company_id when 'match_name' then bn.company_id when 'claim' then bk.company_id end as company_id,
 case when action in ('insert', 'claim') then case when bk is not null and action = 'insert' then concat(k, ':', coalesce(split_part(d, '.', 1), cast(wanted_id as varchar))) else k end end as name_key from a""",
    ),
    "u6_union_of_sources": (
        lambda s, d: ingest.union_of_sources(
            load(s, d, "companies").select((F.col("company_id") % 7).alias("query_id"), F.col("company_id").alias("place"), "name", F.col("domain").alias("website")),
            load(s, d, "results").select((F.col("company_id") % 7).alias("query_id"), F.col("result_id").alias("place"), F.col("title").alias("name"), F.coalesce("url", "href").alias("website")), 60,
        ),
        f"""with recursive r as (select company_id % 7 as query_id, 1 as source, company_id as place, name, domain as website from companies union all select company_id % 7, 2, result_id, title, coalesce(url, href) from results),
 n as (select query_id, source, place, trim(regexp_replace(trim(coalesce(name, '')), '^\\.+|\\.+$', '', 'g')) as name, nullif(array_to_string(string_split(regexp_replace(case when website like '%//%' then regexp_extract(lower(website), '//([^/?#]*)', 1) else lower(website) end, '^www\\.', ''), '.')[-2:], '.'), '') as domain from r),
 f as (select *, row_number() over (partition by query_id order by source, place, name, domain) as i from n where length(name) between 1 and 80 and not coalesce(domain in ({_quoted(text.AGGREGATORS)}), false)),
 g(query_id, i, names, sites, ok) as (select distinct query_id, cast(0 as bigint), cast([] as varchar[]), cast([] as varchar[]), false from f union all
  select g.query_id, f.i, case when list_contains(names, lower(f.name)) or coalesce(list_contains(sites, f.domain), false) then names else list_append(names, lower(f.name)) end,
   case when list_contains(names, lower(f.name)) or coalesce(list_contains(sites, f.domain), false) or f.domain is null then sites else list_append(sites, f.domain) end,
   not (list_contains(names, lower(f.name)) or coalesce(list_contains(sites, f.domain), false)) from g join f on f.query_id = g.query_id and f.i = g.i + 1),
 h as (select f.query_id, row_number() over (partition by f.query_id order by f.i) as place, name, domain from f join g on g.query_id = f.query_id and g.i = f.i and g.ok)
 select query_id, place, name, domain from h where place <= 60""",
    ),
    "u7_merged_candidates": (
        lambda s, d: ingest.merged_candidates(load(s, d, "people").select(F.col("contact_id").alias("candidate_id"), F.when(F.col("contact_id") % 3 == 0, F.upper("person")).otherwise(F.col("person")).alias("person"), "address", "profile", "title", (F.col("contact_id") % 2).cast("string").alias("source"))),
        f"""with c as (select contact_id as candidate_id, case when contact_id % 3 = 0 then upper(person) else person end as person, address, profile, coalesce(title, '') as title, cast(contact_id % 2 as varchar) as src from people),
 k as (select *, lower(trim(person)) as low, lower(trim(address)) as e, nullif(regexp_replace(regexp_replace(trim(profile), '/+$', ''), '(?i)^https?://(www\\.)?linkedin\\.com', 'https://www.linkedin.com'), '') as u from c),
 x as (select *, u is not null or e <> '' as strong, {_CANDIDATE_KEY} as key from k), st as (select low, arg_min(key, candidate_id) as goes from x where strong and low <> '' group by low),
 y as (select x.* exclude (key), case when not strong and goes is not null then goes else key end as key, (case when strong then 0 else 1 end, candidate_id) as o from x left join st using (low))
 select key, min(candidate_id) as candidate_id, coalesce(arg_min(person, o) filter (where person <> ''), '') as person, coalesce(arg_min(address, o) filter (where coalesce(address, '') <> ''), '') as address,
 coalesce(arg_min(profile, o) filter (where coalesce(profile, '') <> ''), '') as profile, coalesce(arg_min(title, o) filter (where title <> ''), '') as title from y group by key""",
    ),
}
