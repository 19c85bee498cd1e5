"""The outreach tables, derived from the given ones in SQL that both Spark and the oracle accept.

``load`` builds them as DataFrames; ``with_views`` puts the same definitions in front of oracle SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from outlake.sources.store import scratch

#: Stands for the current time wherever a rule depends on it.
AS_OF = "timestamp '2001-08-02 00:00:00'"

VIEWS = {
    "companies": """select s_suppkey as company_id,
 concat('Firm ', cast(s_suppkey % 80 as varchar(20)), case s_suppkey % 4 when 0 then ' Inc' when 1 then ' Labs' when 2 then '' else ' Group' end) as name,
 case when s_suppkey % 10 = 9 then null else concat('firm', cast(s_suppkey % 80 as varchar(20)), '.example.com') end as domain,
 case when s_nationkey % 5 = 0 then null else s_nationkey end as campaign_id,
 case s_suppkey % 5 when 0 then 'pending' when 1 then 'scrape_failed' when 2 then 'wrong_site' when 3 then 'no_emails_found' else 'scraped' end as scrape_status,
 timestamp '1994-01-01 00:00:00' + s_suppkey * interval '1' day as created_at
 from supplier""",
    "campaigns": "select n_nationkey as campaign_id, n_name as name, n_nationkey % 7 = 6 as archived from nation",
    "contacts": """select c.c_custkey as contact_id, co.company_id, co.campaign_id, c.c_name as name,
 case when c.c_custkey % 17 = 0 then '' when c.c_custkey % 11 = 0 then concat('info@firm', cast(c.c_custkey % 80 as varchar(20)), '.example.com')
      when c.c_custkey % 7 = 0 then concat('P', cast(c.c_custkey % 500 as varchar(20)), '+tag@Firm', cast(c.c_custkey % 80 as varchar(20)), '.example.com')
      else concat('p', cast(c.c_custkey % 500 as varchar(20)), '@mail.firm', cast(c.c_custkey % 80 as varchar(20)), '.example.com') end as email,
 case when c.c_custkey % 13 = 0 then null else c.c_custkey % 21 end as seniority_rank,
 case when c.c_custkey % 17 = 0 then 'none' when c.c_custkey % 11 = 0 then 'generic' when c.c_custkey % 3 = 0 then 'personal' else 'named_unmatched' end as email_kind,
 case c.c_mktsegment when 'BUILDING' then 'new' when 'MACHINERY' then 'drafted' when 'FURNITURE' then 'sent' when 'AUTOMOBILE' then 'replied' else case when c.c_custkey % 4 = 0 then 'archived' else 'new' end end as status,
 c.c_custkey % 2 = 0 as person_verified,
 case when c.c_custkey % 23 = 0 then timestamp '1999-01-01 00:00:00' end as bounced_at,
 case when c.c_custkey % 29 = 0 then timestamp '1999-01-01 00:00:00' end as follow_ups_declined_at
 from customer c left join companies co on co.company_id = c.c_custkey % (select count(*) from supplier)""",
    "emails": """select b.o_orderkey as email_id, b.o_custkey as contact_id, ct.company_id, ct.campaign_id,
 case b.o_orderpriority when '1-URGENT' then 'application' when '2-HIGH' then 'coffee_chat' when '3-MEDIUM' then 'sales' when '4-NOT SPECIFIED' then 'custom' else '' end as email_type,
 b.status, b.o_orderdate as created_at,
 case when b.status = 'sent' and b.o_orderkey % 31 <> 0 then b.o_orderdate end as sent_at,
 case when b.status = 'sent' and b.o_orderkey % 37 <> 0 then concat('g', cast(b.o_orderkey as varchar(20))) end as gmail_message_id,
 case when b.o_orderkey % 41 = 0 then null when b.o_orderkey % 43 = 0 then 'old@elsewhere.example.org' else lower(ct.email) end as recipient_email,
 b.status = 'sent' and b.o_orderkey % 5 = 0 as has_response,
 case when b.status = 'sent' and b.o_orderkey % 5 = 0 then b.o_orderdate + (b.o_orderkey % 200 - 5) * interval '1' hour end as response_at,
 case when b.status = 'sent' and b.o_orderkey % 10 = 0 then b.o_orderdate + interval '30' day end as response_verified_at,
 b.rn > 1 and b.o_orderkey % 7 in (1, 3) as is_follow_up,
 case when b.rn > 1 and b.o_orderkey % 7 in (1, 3) then b.root_id end as original_email_id,
 case when b.rn > 1 and b.o_orderkey % 7 = 1 then 1 else 0 end as follow_up_step,
 b.o_orderkey % 4 = 0 as used_template_fallback,
 case when b.status in ('draft','approved') and b.o_orderkey % 8 = 0 then b.o_orderdate + interval '3' day end as scheduled_at,
 case when b.status in ('draft','approved') and b.o_orderkey % 9 = 0 then b.o_orderdate end as send_attempted_at,
 case when b.status = 'sent' and b.o_orderkey % 19 = 0 then b.o_orderdate + interval '1' hour end as bounced_at
 from (select *, case o_orderstatus when 'F' then 'sent' when 'O' then 'draft' else case o_orderkey % 3 when 0 then 'approved' when 1 then 'trashed' else 'sent' end end as status,
   row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn,
   first_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as root_id from orders) b
 left join contacts ct on ct.contact_id = b.o_custkey""",
    "suppressions": """select c_custkey as suppression_id, case when c_custkey % 2 = 0 then 'address' else 'domain' end as kind,
 case when c_custkey % 2 = 0 then concat('p', cast(c_custkey % 500 as varchar(20)), '@firm', cast(c_custkey % 80 as varchar(20)), '.example.com') else concat('firm', cast(c_custkey % 80 as varchar(20)), '.example.com') end as value,
 timestamp '1998-01-01 00:00:00' + c_custkey * interval '1' hour as created_at from customer where c_custkey % 101 = 3 or c_custkey % 98 = 0""",
    "messages": """select conv_id as thread_id, turn as message_no, case role when 'user' then 'REPLY' when 'assistant' then 'OWN' else 'AUTO' end as kind, text as body from conversations""",
    "activity": """select event_id, ts as created_at, user_id as entity_id, event_type as event, value, cast(props as varchar(200)) as detail from events""",
    "people": """select contact_id, company_id, company, domain, seniority_rank, status,
 case when contact_id % 19 = 0 then '' when contact_id % 6 = 0 then concat(given, ' ', family, ', PhD') else concat(given, ' ', family) end as person,
 case contact_id % 8 when 0 then '' when 1 then lower(concat(given, '.', family, '@', dom)) when 2 then lower(concat(substr(given, 1, 1), family, '@', dom)) when 3 then concat('info@', dom)
  when 4 then concat('legal@', dom) when 5 then concat(' ', upper(given), '.', family, '+x@', upper(dom)) when 6 then 'not an address'
  else concat('kim.lee@', case when contact_id % 3 = 0 then 'googlemail.com' else 'other.example.org' end) end as address,
 case contact_id % 9 when 0 then '' when 1 then lower(concat('https://www.linkedin.com/in/', given, '-', family)) when 2 then lower(concat('http://linkedin.com/in/', given, '-', family, '-a1b2c3/'))
  when 3 then lower(concat('https://linkedin.com/in/', given)) when 4 then 'https://www.linkedin.com/company/x' when 5 then 'https://example.org/in/ana-doe'
  when 6 then concat('https://www.LinkedIn.com/in/', family, '-', given, '-42?x=1') when 7 then 'www.linkedin.com/in/x' end as profile,
 split_part('Chief Executive Officer|co-founder and CTO|Head of Sales|Talent partner at Firm|Engineer|vice president|Managing Partner|the chief data officer||Hiring Manager', '|', cast(contact_id % 10 as integer) + 1) as title,
 case contact_id % 5 when 1 then 'Criteria match: Penn, ML; met at a fair' when 2 then 'a criteria  match' when 3 then concat('CRITERIA MATCH: ml , Robotics ', cast(contact_id % 4 as varchar(20))) when 4 then 'no match' end as notes,
 case contact_id % 3 when 0 then false when 1 then true end as accepts, contact_id % 4 = 1 as name_from_email, contact_id % 2 = 0 as on_domain
 from (select ct.contact_id, ct.company_id, ct.seniority_rank, ct.status, co.name as company, co.domain, coalesce(co.domain, 'nowhere.example.org') as dom,
  split_part('Ana Bob Cleo Dan Eva Finn Gil Hana Ivo Jane Kim', ' ', cast(ct.contact_id % 11 as integer) + 1) as given,
  split_part('Adler Brown Cruz Doe Evans Fox Gray Hill Lee', ' ', cast(ct.contact_id % 9 as integer) + 1) as family
  from contacts ct left join companies co on co.company_id = ct.company_id) p""",
    "headers": """select conv_id as thread_id, turn as message_no, text as body, k % 6 = 0 as sent_label, conv_id * 100000 + (turn * 37 % 11) * 1000 as internal_ms,
 case k % 8 when 0 then '"Jane Doe" <jane@x.example.com>' when 1 then 'MAILER-DAEMON@mail.example.com (Mail Delivery System)' when 2 then 'me@own.example.com' when 3 then 'Me <ME@own.example.com>'
  when 4 then 'no-reply@shop.example.com' when 5 then 'some@own.example.com' when 6 then '<chris@postmasterlabs.example.com>' else 'Jane Doe' end as sender,
 case k % 7 when 0 then 'Re: hello' when 1 then 'Delivery failure about parcels' when 2 then 'Out of office' when 3 then 'Undeliverable: hi' when 4 then 'Automatic reply: x' when 5 then '' end as subject,
 case k % 5 when 0 then 'Auto-Replied' when 1 then 'no' when 2 then '' when 3 then 'auto-generated' end as auto_submitted,
 case when k % 11 = 0 then 'multipart/report; report-type = delivery-status' else 'text/plain' end as content_type,
 case when k % 13 = 0 then '<MAILER-DAEMON@x.example.com>' else '' end as return_path, case when k % 17 = 0 then 'x@y.example.com' end as failed
 from (select *, conv_id * 7 + turn as k from conversations) c""",
    "runs": """select o_orderkey as run_id, o_custkey % (select count(*) from supplier) as company_id, o_orderdate as researched_at,
 case when o_orderkey % 4 <> 0 then concat('job', cast(o_orderkey % 30 as varchar(20))) end as job_id,
 case o_orderkey % 5 when 0 then '' when 1 then 'Penn alumni; ML' when 2 then ' Penn  alumni; ML ' when 3 then 'Robotics' end as criteria,
 case when o_orderkey % 3 = 0 then 10 + o_orderkey % 90 end as employee_estimate,
 concat('Firm opened office no. ', cast(o_orderkey % 6 as varchar(20))) as bullet_1, concat('FIRM  opened office, no ', cast(o_orderkey % 9 as varchar(20)), '!') as bullet_2,
 concat('Remote policy ', cast(o_orderkey % 4 as varchar(20))) as bullet_3, concat('News item ', cast(o_orderkey % 14 as varchar(20))) as news
 from orders""",
    "send_windows": """select s_suppkey as sender_id, case when s_suppkey % 7 = 0 then null else s_suppkey % 7 <> 1 end as enabled,
 case s_suppkey % 4 when 0 then 'Asia/Kolkata' when 1 then 'UTC' when 2 then ' ' else 'Nowhere/Town' end as zone,
 case s_suppkey % 5 when 0 then '0,1,2,3,4' when 1 then '6,5,5,9' when 2 then '' when 3 then '2' else '-1,3,1' end as days,
 case when s_suppkey % 11 = 0 then null else cast(s_suppkey % 29 as integer) - 3 end as start_hour, case when s_suppkey % 6 = 0 then 17 else cast(s_suppkey % 31 as integer) end as end_hour,
 case s_suppkey % 6 when 0 then '7' when 1 then '0,14,200,x,5' when 2 then '' when 3 then 'a,b' when 4 then '3,3,3,3,3,3' else '1.5,30' end as steps,
 timestamp '2001-08-01 00:00:00' + s_suppkey * interval '97' minute as moment
 from supplier""",
    "results": """select p_partkey as result_id, p_partkey % (select count(*) from supplier) as company_id,
 case p_partkey % 6 when 0 then concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), ' - about us') when 1 then concat('Top 10 companies: ', p_name) when 2 then concat(p_name, ' | ', p_type) when 3 then '' when 4 then null
  else concat('Firm ', cast(p_partkey % 80 as varchar(20)), ' news: launch') end as title,
 case p_partkey % 5 when 0 then '' when 1 then null else concat('https://www.site', cast(p_partkey % 40 as varchar(20)), '.example.com/', p_brand) end as href,
 case when p_partkey % 7 = 0 then concat('https://', case when p_partkey % 3 = 0 then 'www.linkedin.com/in/x' else 'alt.example.org' end) end as url,
 case p_partkey % 4 when 0 then null when 1 then concat('Firm ', cast(p_partkey % (select count(*) from supplier) % 80 as varchar(20)), ' announces a ', p_name, ' for everyone') when 2 then 'short' else concat('A team of ', cast(p_size as varchar(20)), ' people at Firm ', cast(p_partkey % 80 as varchar(20))) end as body
 from part""",
    "verdicts": """select event_id as verdict_no, event_id % (select count(*) from orders) + 1 as email_id, ts as checked_at, case event_type when 'click' then 'reply' when 'view' then 'none' when 'purchase' then 'bounce' when 'error' then 'unknown' else 'none' end as verdict from events""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_FROM = re.compile(r"\b(from|join) (\w+)")


#: Views that many queries read: written once per session and source, then read as tables.
TABLES_OF_SESSION = ("companies", "contacts", "emails", "people")
_written: dict[tuple, DataFrame] = {}


def _stamp(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int, int]:
    """When a given table was last changed, and its files' number and size: folders on object stores have no time of
    their own, and a part that is rewritten leaves the folder's as it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    held = files.getContentSummary(at)
    return files.getFileStatus(at).getModificationTime(), held.getFileCount(), held.getLength()


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {m for _, m in _FROM.findall(text) if m in VIEWS or m in TABLES}
    return spark.sql(_FROM.sub(lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], text), **{u: load(spark, sf_dir, u) for u in used})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a given table as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in TABLES_OF_SESSION:
        return _view(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, sf_dir, name, *[_stamp(spark, sf_dir, t) for t in ("supplier", "customer", "orders")])
    if key not in _written:
        view, path = _view(spark, sf_dir, name), f"{scratch(spark)}/{name}"
        view.write.parquet(path)
        _written[key] = spark.read.schema(view.schema).parquet(path)
    return _written[key]


def with_views(sql: str) -> str:
    """``sql`` with the definitions that it uses, directly or not, in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(sql)
    defined = [f"{n} as ({VIEWS[n]})" for n in needed]
    body = sql.strip()
    for opening in ("with recursive ", "with "):
        if body.lower().startswith(opening):
            return opening + ", ".join([*defined, body[len(opening) :]])
    return ("with " + ", ".join(defined) + " " if defined else "") + body
