"""Registered queries: merges of duplicates, imports, page endpoints, the send gate in full, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outlake.functions import identity, mail, people, text
from outlake.operators import analytics, campaigns, duplicates, filters, followups, gates, ingest, links, states, suppression
from outlake.plans.entities import ENTITIES
from outlake.plans.more import MORE, _mx
from outlake.plans.people import PARTS
from outlake.plans.reports import _DUE, _FACTS, _SEGMENTS, STEPS, _facts
from outlake.plans.research import _key
from outlake.plans.states import _SENT, _SUBJECT, STATES, _sql
from outlake.plans.views import AS_OF, load
from outlake.sources import store
from outlake.sources.store import event_stream
from outlake.streaming import streams

_CLEAN = "nullif(lower(trim(coalesce({0}, ''))), '')"
_U1 = f"""d as (select contact_id, company_id, {_CLEAN.format('address')} as e, {_CLEAN.format('profile')} as u, on_domain from people),
 d1 as (select *, case when e is not null and company_id is not null then first_value(contact_id) over (partition by company_id, e order by not on_domain, contact_id) else contact_id end as k1 from d),
 d2 as (select contact_id, case when u is not null and company_id is not null then first_value(contact_id) over (partition by company_id, u order by not on_domain, contact_id) else contact_id end as k2 from d1 where k1 = contact_id)"""
#: Data addresses that differ from page to page: of the page's own site, relative, elsewhere, and static files.
_CARRY = """concat('<div>fetch("/api/staff', cast(page_id % 7 as varchar(20)), '.json")</div><a href="/about/data/x', cast(page_id as varchar(20)), '.json#y">a</a><a href="https://other.org/api/x">o</a><img src="/api/x.png"><i x="/wp-json/v', cast(page_id % 3 as varchar(20)), '/y/"></i>',
 case when page_id % 2 = 0 then concat('<a href="', url, '/cms/list">', '</a>') else '' end, case when page_id % 5 = 0 then '<p>/graphql/people /data/a /data/b /data/c /data/d /data/e /data/f</p>' else '' end)"""


_COMPANY_SORTS = {"name": ["lower(name)"], "contacts": ["-coalesce(n, 0)"], "research": ["case when scrape_status = 'scraped' then 1 else 0 end", "lower(name)"], "newest": ["-company_id"]}
_LINKS = """concat('<a href="/team">Our team</a><a href="/about-us#x">us</a><a href="https://other.org/team">x</a><a href="/news/', cast(page_id % 3 as varchar(20)), '">n</a><a href="/login/people">l</a><a href="/about-us/">again</a><a href="/x">Contact</a>')"""


def _dives(s, d):
    k, c = F.col("company_id"), load(s, d, "companies")
    return c.select(
        "company_id", F.when(k % 4 != 0, F.concat(F.lit("new"), k.cast("string"), F.lit(".example.org"))).alias("new_domain"), F.when(k % 6 != 0, F.concat(F.lit("Fresh "), "name")).alias("new_summary"),
        F.when(k % 7 == 0, "wrong_site").otherwise("scraped").alias("status"), (k % 11 != 0).alias("identity_ok"), (k % 3 == 0).alias("contacts_only"),
    )


def _best():
    return [F.when(F.col("on_domain"), 0).otherwise(1)]


def _imported(s, d):
    """Contacts written in both CSV dialects and read back; some have an address, some a profile alone."""
    p, q = (load(s, d, "people").where(f"contact_id % 2 = {k}") for k in (0, 1))
    at = store.scratch(s)
    p.select(F.col("person").alias(" Name"), F.col("company").alias("company"), F.trim("address").alias("EMAIL"), F.col("profile").alias("LinkedIn_URL"), F.col("title").alias("role"), F.when(F.col("contact_id") % 4 == 0, "met at a fair").alias("Affinity"), F.lit("x").alias("more")).write.option("header", True).csv(f"{at}/own")
    first, rest = F.substring_index("person", " ", 1), F.substring_index("person", " ", -1)
    q.select(first.alias("First Name"), rest.alias("Last Name"), F.col("profile").alias("URL"), F.trim("address").alias("Email Address"), F.col("company").alias("Company"), F.col("title").alias("Position")).write.option("header", True).csv(f"{at}/connections")
    return store.read_contacts_csv(s, f"{at}/own").unionByName(store.read_contacts_csv(s, f"{at}/connections")).select("name", "company", "email", "linkedin_url", "role", "affinity", "source")


def _verified_sites(s, d):
    """Results of a company whose page isn't about it lose their addresses."""
    r = load(s, d, "results").join(load(s, d, "companies").select("company_id", "name", "domain"), "company_id")
    ours = people.domain_matches_name(F.col("name"), F.when(F.col("result_id") % 2 == 0, F.col("domain"))) | people.page_mentions_company(F.col("name"), F.concat_ws(" ", "title", "body"))
    return r.select("result_id", ours.alias("ours"), F.when(ours, F.concat(F.lit("info@"), F.col("domain"))).alias("email"))


def _snippets(s, d):
    """Search results on people, for each person's company."""
    p = load(s, d, "people").where("company is not null and person <> ''")
    k = F.col("contact_id") % 6
    title = F.when(k == 0, F.concat("person", F.lit(" - Engineer at "), "company")).when(k == 1, F.concat("person", F.lit(" | Globex"))).when(k == 2, "We're hiring").when(k == 3, F.col("person")).when(k == 4, F.concat("person", F.lit(" - "), "company")).otherwise(F.col("person"))
    body = F.when(k == 2, F.concat(F.lit("join "), "company")).when(k == 3, F.concat(F.lit("Formerly; ex "), "company")).when(k == 5, F.concat(F.lit("Works at "), "company", F.lit(" now"))).otherwise(F.concat(F.lit("Team of "), "company"))
    return p.select("contact_id", text.is_employee_snippet(F.col("company"), title, body).alias("employee"))


MERGES = {
    "a9_campaign_totals": (
        lambda s, d: campaigns.rollup(*[load(s, d, t) for t in ("campaigns", "emails", "contacts", "companies")]).agg(F.count("*").alias("campaigns"), F.count_if(~F.col("archived")).cast("long").alias("active"), F.sum("sent").alias("sent"), F.sum("replied").alias("replied")),
        """with e as (select campaign_id, count_if(gmail_message_id is not null or sent_at is not null or status = 'sent') as sent, count_if(has_response and response_verified_at is not null) as replied from emails where campaign_id is not null group by 1)
 select count(*) as campaigns, cast(count_if(not archived) as bigint) as active, cast(sum(coalesce(sent, 0)) as bigint) as sent, cast(sum(coalesce(replied, 0)) as bigint) as replied from campaigns left join e using (campaign_id)""",
    ),
    "o1_segments_in_order": (
        lambda s, d: analytics.all_segments(_facts(s, d)).withColumn("place", F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("sent"), "label", "key")).cast("long")).select("dimension", "key", "sent", "place"),
        f"with {_FACTS}, {_SEGMENTS} select dimension, key, sent, row_number() over (partition by dimension order by sent desc, label, key) as place from segments",
    ),
    "u1_collapsed_people": (
        lambda s, d: duplicates.collapsed_contacts(load(s, d, "people"), F.col("address"), F.col("profile"), _best()),
        f"with {_U1} select d1.contact_id, coalesce(d2.k2, d1.k1) as keep_id from d1 left join d2 on d2.contact_id = d1.k1",
    ),
    "u2_cleared_identifiers": (
        lambda s, d: _cleared(load(s, d, "people")),
        f"""with r as (select contact_id, address, profile, case when {_CLEAN.format('address')} is not null then row_number() over (partition by {_CLEAN.format('address')} order by not on_domain, contact_id) else 1 end as a,
  case when {_CLEAN.format('profile')} is not null then row_number() over (partition by {_CLEAN.format('profile')} order by not on_domain, contact_id) else 1 end as b from people)
 select contact_id, case when a > 1 then '' else address end as address, case when b > 1 then '' else profile end as profile from r""",
    ),
    "u3_merged_companies": (
        lambda s, d: duplicates.merged_companies(load(s, d, "companies"), identity.company_name_key(F.col("name"))),
        f"""with c as (select company_id, domain, created_at, {_key('name')} as k from companies), m as (select *, case when domain is not null then first_value(company_id) over (partition by lower(domain) order by created_at, company_id) else company_id end as keep_id from c),
 n as (select company_id, case when k is null or row_number() over (partition by k order by created_at, company_id) = 1 then k else concat(k, ':', coalesce(split_part(domain, '.', 1), cast(company_id as varchar))) end as name_key from m where keep_id = company_id)
 select m.company_id, keep_id, name_key from m left join n using (company_id)""",
    ),
    "s2_imported_contacts": (
        _imported,
        """select trim(person) as name, coalesce(company, '') as company, trim(address) as email, coalesce(trim(profile), '') as linkedin_url, coalesce(title, '') as role, case when contact_id % 4 = 0 then 'met at a fair' else '' end as affinity, 'csv' as source from people where contact_id % 2 = 0
 union all select trim(concat_ws(' ', split_part(person, ' ', 1), split_part(person, ' ', -1))), coalesce(company, ''), trim(address), coalesce(trim(profile), ''), coalesce(title, ''), 'Direct LinkedIn connection', 'connections' from people where contact_id % 2 = 1""",
    ),
    "j15_verified_sites": (
        _verified_sites,
        """with r as (select result_id, lower(concat_ws(' ', title, body)) as t, c.domain, c.company_id % 80 as k from results r join companies c on c.company_id = r.company_id),
 o as (select result_id, domain, (result_id % 2 = 0 and domain is not null) or contains(regexp_replace(t, '[^a-z0-9]+', '', 'g'), 'firm' || k) or (contains(' ' || regexp_replace(t, '[^a-z0-9]+', ' ', 'g') || ' ', ' firm ') and contains(' ' || regexp_replace(t, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || k || ' ')) as ours from r)
 select result_id, ours, case when ours then 'info@' || domain end as email from o""",
    ),
    "f40_o11_page_endpoints": (
        lambda s, d: load(s, d, "pages").select("page_id", F.posexplode(text.endpoints(F.concat(F.expr(_CARRY), "html"), F.col("url"))).alias("place", "x")).select("page_id", "place", "x.rank", "x.url"),
        rf"""with p as (select page_id, regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) as o, {_CARRY} || html as h from pages),
 r as (select page_id, o, unnest(list_concat(regexp_extract_all(h, '(?i)(?:fetch|axios\.(?:get|post)|\$\.(?:get|ajax))\s*\(\s*[''"]([^''"]+)[''"]', 1), regexp_extract_all(h, '(?i)(https?://[^\s"''<>\\]+|/(?:api|graphql|wp-json|data|cms)[^\s"''<>\\]*|[^\s"''<>\\]+\.json(?:\?[^\s"''<>\\]*)?)', 1))) as x from p where o <> ''),
 c as (select page_id, o, regexp_replace(regexp_replace(trim(x), '[\\)]+$', ''), '#.*$', '') as x from r),
 w as (select page_id, o, case when regexp_matches(x, '(?i)^https?://') then x when starts_with(x, '//') then regexp_extract(o, '^([a-zA-Z]+:)', 1) || x when starts_with(x, '/') then o || x end as u from c),
 f as (select distinct page_id, regexp_replace(u, '/+$', '') as u from w where lower(regexp_extract(u, '(?i)^(https?://[^/?#]+)', 1)) = lower(o)
   and regexp_matches(regexp_extract(u, '(?i)^https?://[^/?#]*([^?#]*)', 1), '(?i)(\.json$|^/api|/api/|^/wp-json|/wp-json/|/graphql|/data/|/cms/)') and not regexp_matches(regexp_extract(u, '(?i)^https?://[^/?#]*([^?#]*)', 1), '(?i)\.(js|css|png|jpg|jpeg|gif|svg|woff|woff2|map)$')),
 k as (select *, regexp_extract(u, '(?i)^https?://[^/?#]*([^?#]*)', 1) as t from f), m as (select page_id, u, case when regexp_matches(t, '(?i)team|people|staff|leadership|employee') then 0 when regexp_matches(t, '(?i)about|contact|company') then 1 when contains(lower(t), 'wp-json') then 2 else 3 end as rank from k),
 n as (select *, row_number() over (partition by page_id order by rank, u) - 1 as place from m) select page_id, cast(place as integer) as place, cast(rank as integer) as rank, u as url from n where place < 8""",
    ),
    "p13_employee_snippets": (
        _snippets,
        "select contact_id, contact_id % 6 in (0, 4, 5) as employee from people where company is not null and person <> ''",
    ),
    "o9_due_in_order": (
        lambda s, d: followups.due(load(s, d, "emails"), load(s, d, "contacts"), STEPS, AS_OF).orderBy("last_touch_at", "email_id").select("email_id", "contact_id", "last_touch_at"),
        f"with {_DUE} select email_id, contact_id, last_touch_at from due order by last_touch_at, email_id",
    ),
    "a33_draft_decisions": (
        lambda s, d: gates.draft_gate(load(s, d, "contacts"), load(s, d, "emails"), load(s, d, "suppressions"), 2).groupBy("decision").agg(F.count("*").alias("n")),
        f"select decision, count(*) as n from ({MORE['g2_draft_gate'][1]}) group by 1",
    ),
    "f5_registered_domains": (
        lambda s, d: load(s, d, "pages").select("page_id", identity.registered_domain(F.when(F.col("page_id") % 4 == 0, "https://u@www.shop.co.uk:80/x").when(F.col("page_id") % 4 == 1, "a.b.gov.au").when(F.col("page_id") % 4 == 2, "localhost").otherwise(F.col("url"))).alias("domain")),
        r"""select page_id, case page_id % 4 when 0 then 'shop.co.uk' when 1 then 'b.gov.au' when 2 then 'localhost' else array_to_string(string_split(regexp_replace(regexp_extract(lower(trim(url)), '//([^/?#]*)', 1), '^www\.', ''), '.')[-2:], '.') end as domain from pages""",
    ),
    "f17_guessed_names": (
        lambda s, d: load(s, d, "people").select("contact_id", identity.name_from_local(F.col("address")).alias("name")),
        f"""with {PARTS}, q as (select contact_id, generic, list_filter(regexp_split_to_array(split_part(e, '@', 1), '[._-]+'), lambda p: p <> '') as w from pb)
 select contact_id, case when len(w) between 2 and 3 and len(list_filter(w, lambda p: not regexp_full_match(p, '[a-z]{{2,}}'))) = 0 and not generic then array_to_string(list_transform(w, lambda p: upper(p[1]) || p[2:]), ' ') end as name from q""",
    ),
    "j9_coverage_in_full": (
        lambda s, d: suppression.coverage(load(s, d, "contacts"), load(s, d, "suppressions"), "contact_id", "email").select("suppression_id", "matched", load(s, d, "contacts").where("trim(coalesce(email, '')) <> ''").agg(F.count("*")).scalar().alias("checked")),
        f"""with c as ({ENTITIES['j9_suppression_coverage'][1]}) select suppression_id, matched, (select count(*) from contacts where trim(coalesce(email, '')) <> '') as checked from c""",
    ),
    "g9_saved_dives": (
        lambda s, d: states.dive_saved(_dives(s, d), load(s, d, "companies").where("scrape_status <> 'scraped'").withColumn("summary", F.concat(F.lit("About "), F.col("name")))),
        """with k as (select *, 'About ' || name as summary from companies where scrape_status <> 'scraped'),
 f as (select company_id, case when company_id % 4 <> 0 then 'new' || company_id || '.example.org' end as nd, case when company_id % 6 <> 0 then 'Fresh ' || name end as ns, case when company_id % 7 = 0 then 'wrong_site' else 'scraped' end as status, company_id % 11 <> 0 as ok, company_id % 3 = 0 as only_contacts from companies),
 j as (select f.*, k.domain, k.summary, k.scrape_status, k.company_id is not null as prior, ok and status <> 'wrong_site' as trusted from f left join k on k.company_id = f.company_id), t as (select *, trusted and not (only_contacts and prior) as takes from j)
 select company_id, case when takes then coalesce(nd, domain) when prior then domain end as domain, case when takes then ns when prior then summary end as summary, case when takes then status when prior then scrape_status else status end as scrape_status,
 case when trusted then 'saved' when prior then 'kept' else 'blank' end as outcome from t""",
    ),
    "o8_extraction_order": (
        lambda s, d: ingest.extraction_order(load(s, d, "people").withColumn("school_match", F.col("contact_id") % 7 == 0)),
        f"""with {PARTS} select company_id, contact_id, row_number() over (partition by company_id order by contact_id % 7 <> 0, coalesce(seniority_rank, 20), not on_domain, person = '', generic, lower(coalesce(nullif(trim(address), ''), profile, '')), contact_id) as place from pb""",
    ),
    "o3_company_sorts": (
        lambda s, d: filters.sorted_places(load(s, d, "companies").join(load(s, d, "contacts").groupBy("company_id").agg(F.count("*").alias("n")), "company_id", "left"), _COMPANY_SORTS, "company_id", 15),
        "with c as (select c.*, n from companies c left join (select company_id, count(*) as n from contacts group by 1) x on x.company_id = c.company_id) "
        + " union all ".join(f"select '{k}' as sort, company_id, place from (select company_id, row_number() over (order by {', '.join(o)}, company_id) as place from c) where place <= 15" for k, o in _COMPANY_SORTS.items()),
    ),
    "t7_once_per_day": (
        lambda s, d: streams.once_per_day(event_stream(s, d)),
        "select distinct entity_id, event, cast(created_at as date) as day from activity",
    ),
    "f30_clean_lines": (
        lambda s, d: load(s, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned")),
        f"""with l as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[\t\r\x0b\x0c ]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 20 and not regexp_matches(lower(x), '{"|".join(text.NAVIGATION)}')
   and length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}_ ]', '', 'g')) >= length(x) * 0.3) as l from documents), s as (select doc_id, list_filter(regexp_split_to_array(array_to_string(l, ' '), '[.!?] +'), lambda x: x <> '') as s from l),
 e as (select doc_id, unnest(s) as x, unnest(range(0, len(s))) as i from s), f as (select doc_id, lower(x) as k, min(i) as i, arg_min(x, i) as x from e group by 1, 2), j as (select doc_id, string_agg(x, '. ' order by i) as j from f group by 1)
 select d.doc_id, trim(case when length(j) > 3000 then concat(substr(j, 1, 3000), '...') else coalesce(j, '') end) as cleaned from documents d left join j on j.doc_id = d.doc_id""",
    ),
    "f39_o10_links_in_order": (
        lambda s, d: links.page_links(load(s, d, "pages").withColumn("html", F.concat(F.expr(_LINKS), F.col("html")))),
        f"""with p as (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as o, regexp_extract_all({_LINKS} || html, '<a href="([^"]*)">([^<]*)</a>', 1) as h, regexp_extract_all({_LINKS} || html, '<a href="([^"]*)">([^<]*)</a>', 2) as t from pages),
 a as (select page_id, o, unnest(h) as h, unnest(t) as t, unnest(range(0, len(h))) as i from p), r as (select page_id, i, regexp_replace(regexp_replace(case when h like '/%' then o || h else h end, '#.*$', ''), '/+$', '') as u, o, lower(regexp_replace(regexp_extract(h, '^(?:https?://[^/]*)?([^?#]*)', 1), '[?#].*', '') || ' ' || trim(t)) as sig from a where h like '/%' or starts_with(h, o || '/')),
 k as (select *, list_min(list_transform(list_filter({[[w, str(n)] for w, n in links.PRIORITY.items()]!r}::varchar[][], lambda x: contains(sig, x[1])), lambda x: cast(x[2] as integer))) as pr from r where len(list_filter({links.SKIP!r}, lambda w: contains(sig, w))) = 0),
 f as (select page_id, u, min((i, pr)) as m from k where pr is not null group by 1, 2), n as (select page_id, u, row_number() over (partition by page_id order by m[2], m[1]) - 1 as place from f) select page_id, cast(place as integer) as place, u as href from n where place < 24""",
    ),
    "f33_page_mail_texts": (lambda s, d: load(s, d, "pages").select("page_id", mail.mail_text(F.col("html")).alias("text")), None),
}


def _cleared(rows):
    """An identifier stays on the best row that has it; the others lose it, nobody is merged."""
    key = lambda c: F.nullif(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(""))
    own = lambda c: F.coalesce(key(c), F.concat(F.lit("\0"), F.col("contact_id").cast("string")))  # noqa: E731  # rows without a key stay apart
    n = lambda c: F.row_number().over(W.partitionBy(own(c)).orderBy(*_best(), "contact_id"))
    at = rows.withColumn("a", n("address")).withColumn("b", n("profile"))
    return at.select("contact_id", F.when(F.col("a") > 1, "").otherwise(F.col("address")).alias("address"), F.when(F.col("b") > 1, "").otherwise(F.col("profile")).alias("profile"))

