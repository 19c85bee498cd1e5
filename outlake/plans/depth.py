"""Registered queries: batches under daily limits, streams in event time, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlake.functions import identity, text
from outlake.operators import claims, filters, gates, ingest, pages, rerun, research, sending, states
from outlake.plans.entities import _MATCH
from outlake.plans.more import _DOMAINS, _REASONS, _mx
from outlake.plans.people import _WINDOW, PARTS, known, window
from outlake.plans.reports import _FOLLOW
from outlake.plans.research import _CANDIDATE_KEY, _GATE
from outlake.plans.states import _LEFT, _SENT, _SUBJECT, STATES, _sql
from outlake.plans.views import load
from outlake.sources.store import event_stream
from outlake.streaming import timed

#: Who sends an email, on which day and in which of the day's batches, and what sending it gives.
_QUEUE = """select email_id, cast(coalesce(company_id, 0) % 4 as integer) as sender, date '2001-07-01' + cast(email_id % 10 as integer) as day, cast(email_id % 3 as integer) as batch,
 email_id as position, case email_id % 7 when 0 then 'refused' when 1 then 'unknown' else 'sent' end as outcome, status = 'sent' and email_id % 4 = 0 as before from {0}"""
_LIMIT, _DRAFTS = 25, 9
#: Requests for drafts, and drafts that the log counts already.
_REQUESTS = """select event_id as request_id, cast(entity_id % 5 as integer) as actor, cast(created_at as date) as day, event_id % 1700 as contact_id from {0} where event in ('click', 'signup')"""
_USED = """select cast(entity_id % 5 as integer) as actor, cast(created_at as date) as day, count(*) as n from {0} where event = 'purchase' group by 1, 2"""


def _batches(s, d):
    queue = _sql(_QUEUE)(s, d, "emails")
    before = queue.where("before").groupBy("sender", "day").agg(F.count("*").alias("n"))
    left = states.reconciled(_sql(_SUBJECT)(s, d, "emails"), _sql(_SENT)(s, d, "emails"))
    tables = [load(s, d, t) for t in ("emails", "contacts", "suppressions")]
    return gates.send_gate_in_full(*tables, _mx(s, d), left, queue.where("not before"), before, _LIMIT)


def _queued(s, d, events):
    """Purchases queue a mail some hours later, errors cancel it; entities have the windows of the senders in turn."""
    w = load(s, d, "send_windows")
    entities = load(s, d, "activity").select("entity_id").distinct().withColumn("sender_id", F.col("entity_id") % w.count() + 1)
    windows = entities.join(w.select("sender_id", window().alias("window")), "sender_id").select("entity_id", "window")
    moment = F.col("created_at") + F.make_dt_interval(hours=(F.col("event_id") % 60).cast("int"))
    return timed.queue_events(events, windows, "purchase", ["error"], moment)


_SWEPT = f"""with {_WINDOW}, e as (select event_id, entity_id, created_at, event, lead(created_at) over (partition by entity_id order by created_at, event_id) as next from activity where event in ('purchase', 'error')),
 q as (select e.*, created_at + (event_id % 60) * interval '1' hour as due, w.* from e left join wn w on w.sender_id = entity_id % (select count(*) from send_windows) + 1 where event = 'purchase'),
 h as (select event_id, due, days, start_hour, end_hour, shift, unnest(range(0, 361)) as i from q where enabled), m as (select *, case when i = 0 then due else date_trunc('hour', due + shift) - shift + i * interval '1' hour end as t from h),
 f as (select event_id, min(t) as opens from m where list_contains(days, isodow(t + shift) - 1) and hour(t + shift) >= start_hour and hour(t + shift) < end_hour group by 1),
 z as (select event_id, next, coalesce(opens > due + interval '72' hour, true) as stale, case when coalesce(opens > due + interval '72' hour, true) then due + interval '72' hour else opens end as fires from q left join f using (event_id))
 select event_id, case when stale then 'stale' else 'due' end as outcome, fires as fired_at from z where (next is null or next > fires) and fires < (select max(created_at) - interval '1' day from e)"""

#: People once more under new and old identifiers, so that candidates of one batch want the same ones.
_BATCH = """select contact_id as candidate_id, company_id + 1 - contact_id % 2 as company_id,
 case when contact_id % 5 < 3 then concat('new', cast(contact_id % 40 as varchar(20)), '@x.io') when contact_id % 5 = 3 then '' else address end as address,
 case contact_id % 4 when 0 then profile when 1 then concat('https://www.linkedin.com/in/New', cast(contact_id % 50 as varchar(20)), '/') else '' end as profile from {0}"""
_AS_KEY = "nullif(lower(regexp_replace(regexp_replace(trim({0}), '/+$', ''), '(?i)^https?://(www\\.)?linkedin\\.com', 'https://www.linkedin.com')), '')"


def _claimed(batch: str, stored: str) -> str:
    """The loop over candidates in order, as a recursion, up to the table ``cl``."""
    ok = "se is null and su is null and not coalesce(list_contains(es, rr.e), false) and not coalesce(list_contains(us, rr.u), false)"
    old = "{{'c': {0}[1], 'b': cast(null as bigint), 'o': {0}[2]}}"
    young = "{{'c': cast(null as bigint), 'b': {0}.candidate_id, 'o': {0}.wants}}"
    return f"""pp as (select contact_id, company_id, nullif(lower(trim(coalesce(address, ''))), '') as e, {_AS_KEY.format('profile')} as u from ({stored})),
 he as (select e, min((contact_id, company_id)) as x from pp where e is not null group by 1), hu as (select u, min((contact_id, company_id)) as x from pp where u is not null group by 1),
 cb as (select candidate_id, company_id as wants, nullif(lower(trim(coalesce(address, ''))), '') as e, {_AS_KEY.format('profile')} as u from ({batch})),
 rr as (select cb.*, he.x as se, hu.x as su, row_number() over (order by candidate_id) as i from cb left join he on he.e = cb.e left join hu on hu.u = cb.u),
 gg(i, es, us, ok) as (select cast(0 as bigint), cast([] as varchar[]), cast([] as varchar[]), false union all
  select rr.i, case when {ok} and rr.e is not null then list_append(es, rr.e) else es end, case when {ok} and rr.u is not null then list_append(us, rr.u) else us end, {ok} from gg join rr on rr.i = gg.i + 1),
 nw as (select rr.* from rr join gg using (i) where gg.ok),
 hd as (select rr.candidate_id, rr.wants, rr.e, rr.u, gg.ok as inserted, case when gg.ok then null else coalesce(case when rr.se is not null then {old.format('rr.se')} when ne.candidate_id < rr.candidate_id then {young.format('ne')} end,
   case when rr.su is not null then {old.format('rr.su')} when nu.candidate_id < rr.candidate_id then {young.format('nu')} end) end as h
  from rr join gg using (i) left join nw ne on ne.e = rr.e left join nw nu on nu.u = rr.u),
 cl as (select hd.*, h.c as contact_id, h.b as by_candidate, h.o as owner_id, coalesce(p.e, n.e) as holder_e, coalesce(p.u, n.u) as holder_u from hd left join pp p on p.contact_id = h.c left join nw n on n.candidate_id = h.b)"""


_STORED = "select contact_id, company_id, address, profile from people"
#: Import: a third of the people are stored, the others come in, some of them once more.
_OLD = "select contact_id, company_id, address, profile from {0} where contact_id % 3 = 0"

_NEWEST = {"companies": ("company_id", True), "contacts": ("contact_id", False), "emails": ("email_id", True), "suppressions": ("suppression_id", True)}


def _newest(s, d):
    """All four lists, newest first."""
    lists = []
    for table, (key, dated) in _NEWEST.items():
        order = [-F.unix_micros(F.col("created_at").cast("timestamp"))] if dated else []
        at = pages.ranked(load(s, d, table).select(key, *["created_at"] * dated), [*order, -F.col(key)])
        lists.append(at.select(F.lit(table).alias("list"), F.col(key).cast("long").alias("id"), "place"))
    return reduce(DataFrame.unionByName, lists)


#: People as they are stored before new research on them, some blank here and there.
_BEFORE = """select contact_id, case when contact_id % 9 = 0 then '' else person end as name, case when contact_id % 4 = 0 then null else 'Engineer' end as role,
 case when contact_id % 5 = 0 then '' when contact_id % 5 = 1 then 'info@firm.example.com' else address end as address, case when contact_id % 3 = 0 then '' else profile end as profile,
 case when contact_id % 5 = 1 then 'generic' else 'unknown' end as email_kind, contact_id % 7 = 0 as email_verified, contact_id % 8 = 0 as person_verified, case when contact_id % 6 = 0 then notes end as notes from {0}"""
#: What a run found about four in five companies.
_FOUND = """select company_id, true as found, case when company_id % 11 <> 0 then concat('https://new', cast(company_id as varchar(20)), '.example.org') end as url, case when company_id % 4 <> 0 then concat('new', cast(company_id as varchar(20)), '.example.org') end as domain,
 case when company_id % 3 <> 0 then 'Fresh summary' end as summary, cast(null as varchar(20)) as industry, cast(company_id % 6 as bigint) as pages_scraped, cast(company_id % 6 + 2 as bigint) as pages_attempted,
 case when company_id % 6 > 3 then 'high' end as research_quality, company_id % 7 <> 0 as ours, company_id % 8 <> 1 as ok, company_id % 2 = 0 as reach from {0} where company_id % 5 <> 4"""
_FIRMS = """select company_id, case when domain is not null then concat('https://', domain) end as url, domain, case when company_id % 2 = 0 then 'Old summary' end as summary, case when company_id % 3 = 0 then 'Trade' end as industry, cast(1 as bigint) as pages_scraped, cast(2 as bigint) as pages_attempted,
 'low' as research_quality, scrape_status from {0}"""
_TAGGED = """select contact_id as candidate_id, case when contact_id % 3 = 0 then upper(person) else person end as person, address, profile, coalesce(title, '') as title, cast(contact_id % 2 as varchar(20)) as source,
 concat('tag', cast(contact_id % 3 as varchar(20)), '|club', cast(contact_id % 2 as varchar(20)), '|tag', cast(contact_id % 4 as varchar(20))) as tags from {0}"""


def _affinities(s, d):
    rows = _sql(_TAGGED)(s, d, "people").withColumn("affinity", F.split("tags", "[|]"))
    return rerun.merged_affinities(rows, ingest.candidate_keys(rows).select("candidate_id", "key", "order")).select("key", F.array_join("affinity", "|").alias("affinity"))


def _columns(s, d):
    status = states.research_status(F.col("new_url").isNotNull(), F.col("new_ours"), F.col("new_ok"), F.col("new_reach"))
    return rerun.company_columns(_sql(_FIRMS)(s, d, "companies"), _sql(_FOUND)(s, d, "companies"), status)


def _merged(s, d):
    p = load(s, d, "people").withColumn("known", known())
    new = p.select("contact_id", "address", F.when(F.col("known.profile_verified"), F.col("profile")).otherwise("").alias("profile"), "person", "title", F.lit("found again").alias("note"), "known")
    return rerun.merged_contacts(new, _sql(_BEFORE)(s, d, "people"), load(s, d, "emails"))


#: Companies on the hosts of pages in turn: some under words of the host's texts, some under a name that no page has.
_HOSTED = """select company_id, case company_id % 4 when 0 then 'Qzx Works Inc' when 1 then 'Qzx Unknown' when 2 then 'The and' else 'Group thre' end as name, case when company_id % 4 = 0 then 'qzxworks.com' end as domain, company_id as slot from {0}"""


def _hosts(s, d):
    """Texts of each host's pages taken together, and the host's place among all."""
    rows = load(s, d, "pages").withColumn("site", F.regexp_extract(F.lower(F.trim("url")), "//([^/?#]*)", 1)).where("site <> ''")
    return research.company_pages(rows, "site", text.visible_text(F.col("html")), "page_id")


def _sites(s, d):
    corpus = _hosts(s, d)
    placed = pages.ranked(corpus.select("site"), [F.col("site")]).select("site", (F.col("place") - 1).alias("slot"))
    firms = _sql(_HOSTED)(s, d, "companies").withColumn("slot", F.col("slot") % placed.count()).join(placed, "slot", "left").select("company_id", "name", "domain", "site")
    return research.site_identity(firms, corpus, load(s, d, "people").select("company_id", "contact_id"))


_U = _AS_KEY.format("profile")
_INBOX = " ".join(f"when '{k}' then '{v}'" for k, v in identity.ROLE_OF_INBOX.items())
DEPTH = {
    "j15_site_identity": (
        _sites,
        rf"""with p as (select page_id, regexp_extract(lower(trim(url)), '//([^/?#]*)', 1) as site,
  substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 5000) as t from pages),
 f as (select *, coalesce(sum(length(t) + 2) over (partition by site order by page_id rows between unbounded preceding and 1 preceding), 0) as ahead from p where length(t) > 80 and site <> ''), g as (select site, substr(string_agg(t, chr(10) || chr(10) order by page_id), 1, 24000) as t from f where ahead < 24000 group by site),
 h as (select site, t, row_number() over (order by site) - 1 as slot from g), k as (select company_id, count(*) as n from people group by 1),
 c as (select x.*, site, regexp_replace(lower(coalesce(t, '')), '[^a-z0-9]+', ' ', 'g') as w from ({_HOSTED.format('companies')}) x left join h on h.slot = x.slot % (select count(*) from g)),
 v as (select *, case company_id % 4 when 0 then true when 1 then contains(replace(w, ' ', ''), 'qzxunknown') or (contains(' ' || w || ' ', ' qzx ') and contains(' ' || w || ' ', ' unknown ')) when 2 then contains(replace(w, ' ', ''), 'and')
   else contains(replace(w, ' ', ''), 'thre') end as verified from c)
 select company_id, verified, cast(case when verified then coalesce(n, 0) else 0 end as bigint) as contacts, case when not verified then coalesce(domain, site) end as mismatch from v left join k using (company_id)""",
    ),
    "g7_merge_in_full": (
        _merged,
        f"""with {PARTS}, bf as ({_BEFORE.format('people')}), ow as (select {_U} as u, min(contact_id) as owner from bf where {_U} is not null group by 1),
 em as (select distinct contact_id from emails where {_LEFT} and contact_id is not null), nw as (select contact_id, trim(coalesce(address, '')) as na, case when profile_verified then profile else '' end as profile, person, title, kind, email_verified as ev, person_match as pm, person_verified as pv from known),
 j as (select bf.*, nw.na, nw.profile as np, nw.u, nw.person as nn, nw.title as nr, nw.kind, nw.ev, nw.pm, nw.pv, ow.owner, em.contact_id is null as free, trim(coalesce(bf.address, '')) as old from bf join (select *, {_U} as u from nw) nw on nw.contact_id = bf.contact_id left join ow on ow.u = nw.u left join em on em.contact_id = bf.contact_id),
 t as (select *, na <> '' and free and (old = '' or (lower(old) <> lower(na) and email_kind = 'generic' and kind = 'personal' and (ev or pm))) as takes, trim(coalesce(profile, '')) = '' and u is not null as wants, coalesce(owner <> contact_id, false) as taken from j),
 z as (select *, na <> '' and (takes or (old <> '' and lower(old) = lower(na))) as sm, wants and not taken as att from t)
 select contact_id, case when trim(coalesce(name, '')) = '' and trim(coalesce(nn, '')) <> '' then nn else name end as name, case when trim(coalesce(role, '')) = '' and trim(coalesce(nr, '')) <> '' then nr else role end as role,
 case when trim(coalesce(notes, '')) = '' then 'found again' else notes end as notes, case when takes then na else old end as address, case when att then np else profile end as profile, case when sm then kind else email_kind end as email_kind,
 case when sm then ev else email_verified end as email_verified, case when (sm and ev) or att then pv else person_verified end as person_verified, case when wants and taken then owner end as conflict from z""",
    ),
    "g8_research_columns": (
        _columns,
        f"""with f as ({_FOUND.format('companies')}), c as ({_FIRMS.format('companies')}), j as (select c.*, f.url as nu, f.domain as nd, f.summary as ns, f.pages_scraped as p1, f.pages_attempted as p2, f.research_quality as p3,
  case when f.found then case when f.url is null then 'no_website' when not ours then 'wrong_site' when not ok then 'scrape_failed' when reach then 'scraped' else 'no_emails_found' end end as st from c left join f on f.company_id = c.company_id)
 select company_id, case when coalesce(st, '') <> 'wrong_site' then coalesce(nu, url) end as url, case when coalesce(st, '') <> 'wrong_site' then coalesce(nd, domain) end as domain, case when coalesce(st, '') <> 'wrong_site' then coalesce(ns, summary) end as summary,
 case when coalesce(st, '') <> 'wrong_site' then industry end as industry, coalesce(p1, pages_scraped) as pages_scraped, coalesce(p2, pages_attempted) as pages_attempted, coalesce(p3, research_quality) as research_quality, coalesce(st, scrape_status) as scrape_status from j""",
    ),
    "a33_discovery_tally": (
        lambda s, d: rerun.discovery_tally(load(s, d, "companies"), load(s, d, "people")),
        "with g as (select company_id, count(*) as n, count_if(trim(coalesce(address, '')) <> '') as e from people group by 1) select scrape_status, count(*) as companies, cast(coalesce(sum(n), 0) as bigint) as contacts, cast(coalesce(sum(e), 0) as bigint) as emails from companies c left join g using (company_id) group by 1",
    ),
    "f61_page_counters": (
        lambda s, d: rerun.page_counters(load(s, d, "results").select("company_id", (F.coalesce("href", F.lit("")) != "").alias("tried"), F.col("body").isNotNull().alias("read")), 8),
        "with g as (select company_id, count_if(coalesce(href, '') <> '') as t, count_if(body is not null) as r from results group by 1) select company_id, cast(least(t, 8) as bigint) as attempted, cast(least(r, t, 8) as bigint) as scraped, cast(greatest(0, 8 - t) as bigint) as remaining from g",
    ),
    "f17_roles_of_inboxes": (
        lambda s, d: load(s, d, "people").select("contact_id", identity.role_of_inbox(F.when(F.col("contact_id") % 3 == 0, F.concat("status", F.lit("@x.io"))).when(F.col("contact_id") % 3 == 1, " Careers@x.io").otherwise(F.col("address"))).alias("role")),
        f"select contact_id, case split_part(lower(trim(case contact_id % 3 when 0 then status || '@x.io' when 1 then ' Careers@x.io' else address end)), '@', 1) {_INBOX} end as role from people",
    ),
    "p4_company_search_in_view": (
        lambda s, d: filters.search(_sql(_FIRMS)(s, d, "companies").join(load(s, d, "companies").select("company_id", "name"), "company_id").where("scrape_status = 'scraped'").join(load(s, d, "contacts").select("company_id").distinct(), "company_id", "left_semi"), ["name", "industry", "summary", "domain"], "1").select("company_id"),
        f"with f as ({_FIRMS.format('companies')}) select company_id from f join (select company_id, name from companies) n using (company_id) where scrape_status = 'scraped' and company_id in (select company_id from contacts where company_id is not null) and (name ilike '%1%' or industry ilike '%1%' or summary ilike '%1%' or domain ilike '%1%')",
    ),
    "u7_merged_affinities": (
        _affinities,
        f"""with c as ({_TAGGED.format('people').replace('as source', 'as src')}), k as (select *, lower(trim(person)) as low, lower(trim(address)) as e, nullif(regexp_replace(regexp_replace(trim(profile), '/+$', ''), '(?i)^https?://(www\\.)?linkedin\\.com', 'https://www.linkedin.com'), '') as u from c),
 x as (select *, u is not null or e <> '' as strong, {_CANDIDATE_KEY} as key from k), st as (select low, arg_min(key, candidate_id) as goes from x where strong and low <> '' group by low),
 y as (select x.* exclude (key), case when not strong and goes is not null then goes else key end as key, case when strong then 0 else 1 end as o from x left join st using (low)),
 t as (select key, o, candidate_id, unnest(string_split(tags, '|')) as tag, unnest([0, 1, 2]) as i from y), f as (select key, tag, min((o, candidate_id, i)) as a from t group by 1, 2)
 select key, string_agg(tag, '|' order by a, tag) as affinity from f group by 1""",
    ),
    "s1_newest_lists": (
        _newest,
        " union all ".join(f"select '{t}' as list, cast({k} as bigint) as id, row_number() over (order by {'created_at desc, ' * dated}{k} desc) as place from {t}" for t, (k, dated) in _NEWEST.items()),
    ),
    "o4_stored_page": (
        lambda s, d: pages.stored(load(s, d, "people").select("contact_id", "person"), [F.lower("person"), F.col("contact_id")], 20).page(4).select("contact_id", "place"),
        "select contact_id, place from (select contact_id, row_number() over (order by lower(person), contact_id) as place from people) where place between 61 and 80",
    ),
    "u10_claims_in_batch": (
        lambda s, d: claims.claimed(_sql(_BATCH)(s, d, "people"), load(s, d, "people")).select("candidate_id", "inserted", "contact_id", "by_candidate", "owner_id"),
        f"with recursive {_claimed(_BATCH.format('people'), _STORED)} select candidate_id, inserted, contact_id, by_candidate, owner_id from cl",
    ),
    "g6_attached_in_batch": (
        lambda s, d: claims.attached(_sql(_BATCH)(s, d, "people"), load(s, d, "people")),
        f"""with recursive {_claimed(_BATCH.format('people'), _STORED)}, fl as (select *, e is not null or u is not null as given, not inserted and owner_id is not null and owner_id is distinct from wants as away from cl),
 ld as (select *, coalesce(e is not null and not away and (inserted or e = holder_e), false) as el, coalesce(u is not null and not away and (inserted or u = holder_u), false) as ul from fl)
 select candidate_id, case when not given then 'nothing' when inserted then 'attach' when away then 'conflict' else 'enrich' end as action, el as email_lands, ul as profile_lands, inserted and (el or ul) as new_outreach,
  case when given then case when away then 'owner' when u is not null and not ul then 'profile' end end as conflict from ld""",
    ),
    "a30_import_outcomes": (
        lambda s, d: claims.import_outcomes(
            load(s, d, "people").select(F.col("contact_id").alias("candidate_id"), "company_id", "address", "profile"),
            ingest.gate(load(s, d, "people"), load(s, d, "suppressions")).select(F.col("contact_id").alias("candidate_id"), "decision"),
            _sql(_OLD)(s, d, "people"),
        ).groupBy("outcome").agg(F.count("*").alias("n")),
        _GATE.replace("with ", "with recursive ", 1).replace(
            " select contact_id, decision, warning from gw",
            f""", {_claimed("select contact_id as candidate_id, company_id, address, profile from people where contact_id in (select contact_id from gw where decision like 'accept%')", _OLD.format('people'))}
 select coalesce(case when inserted then 'added' when not inserted then 'duplicate' end, 'invalid') as outcome, count(*) as n from gw left join cl on cl.candidate_id = gw.contact_id group by 1""",
        ),
    ),
    "g4_send_gate_in_full": (
        _batches,
        f"""with {_REASONS}, rc as ({STATES['j17_reconciled_attempts'][1]}), mx as (select domain, case when length(domain) % 3 = 0 then false when length(domain) % 3 = 1 then true end as accepts from ({_DOMAINS})),
 qu as ({_QUEUE.format('emails')}), used as (select sender, day, count(*) as n from qu where before group by 1, 2),
 jd as (select qu.*, coalesce(trim(r.addr), '') as recipient, coalesce(r.is_follow_up, false) as fu, case when r.reason = 'attempt pending' and rc.outcome = 'delivered' then 'reconciled' when r.reason is null and not coalesce(accepts, true) then 'no mail acceptance' else r.reason end as reason
  from qu join r on r.email_id = qu.email_id left join mx on mx.domain = split_part(r.addr, '@', -1) left join rc on rc.email_id = qu.email_id where not before),
 mk as (select sender, day, batch, recipient, fu, min(position) as marked from jd where reason is null and outcome in ('sent', 'unknown') and recipient <> '' group by all),
 ag as (select jd.*, coalesce(reason in ('not sendable', 'already delivered'), false) as first, coalesce(position > marked, false) as later from jd left join mk using (sender, day, batch, recipient, fu)),
 ak as (select *, not first and not later and not coalesce(reason in ('reconciled', 'attempt pending'), false) as asks from ag),
 cn as (select ak.*, coalesce(used.n, 0) + coalesce(sum(case when asks and reason is null and outcome = 'sent' then 1 else 0 end) over (partition by ak.sender, ak.day order by batch, position rows between unbounded preceding and 1 preceding), 0) as sent from ak left join used on used.sender = ak.sender and used.day = ak.day),
 st as (select sender, day, batch, min(position) as stop from cn where asks and sent >= {_LIMIT} group by 1, 2, 3)
 select email_id, case when position >= stop then 'daily limit' when first then reason when later then 'duplicate' else coalesce(reason, outcome) end as decision from cn left join st using (sender, day, batch)""",
    ),
    "g2_drafts_per_day": (
        lambda s, d: sending.draft_batches(_sql(_REQUESTS)(s, d, "activity"), load(s, d, "contacts"), gates.draft_reasons(*[load(s, d, t) for t in ("contacts", "emails", "suppressions")]).select("contact_id", "reason"), _sql(_USED)(s, d, "activity"), _DRAFTS),
        f"""with {_MATCH}, ww as (select distinct contact_id from emails where not {_FOLLOW} and status in ('sent', 'draft', 'approved')),
 rs as (select c.contact_id, case when trim(coalesce(email, '')) = '' then 'no email' when p.contact_id is not null then 'suppressed' when c.status = 'archived' then 'archived' when ww.contact_id is not null then 'already contacted' end as reason
  from contacts c left join (select * from picked where n = 1) p on p.contact_id = c.contact_id left join ww on ww.contact_id = c.contact_id),
 rq as (select q.*, case when rs.contact_id is null then 'not found' else reason end as reason from ({_REQUESTS.format('activity')}) q left join rs on rs.contact_id = q.contact_id),
 fs as (select *, case when reason is null and request_id > min(case when reason is null then request_id end) over (partition by actor, day, contact_id) then 'already contacted' else reason end as why from rq),
 nn as (select fs.*, coalesce(u.n, 0) + coalesce(sum(case when why is null then 1 else 0 end) over (partition by fs.actor, fs.day order by request_id rows between unbounded preceding and 1 preceding), 0) as drafts from fs left join ({_USED.format('activity')}) u on u.actor = fs.actor and u.day = fs.day)
 select request_id, coalesce(why, case when drafts >= {_DRAFTS} then 'daily limit' else 'draft' end) as decision from nn""",
    ),
    "t4_swept_queue": (lambda s, d: timed.due_sweep(_queued(s, d, event_stream(s, d)), "1 day"), _SWEPT),
    "t4_swept_queue_in_batch": (
        lambda s, d: timed.due_sweep_twin(_queued(s, d, load(s, d, "activity").withColumn("created_at", F.col("created_at").cast("timestamp"))), "1 day"),
        _SWEPT,
    ),
}
