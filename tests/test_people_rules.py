"""Rules on people, mails, schedules and payloads with literal cases."""

import datetime as dt
import html
import re

from pyspark.sql import functions as F

from outlake.functions import identity, mail, people, schedule, text
from outlake.operators import ingest, replies, research, states, terms
from outlake.plans.views import load
from outlake.sources import store
from tests.conftest import SF


def column(spark, values, use):
    """``use`` of a string column that holds ``values``, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in df.select("i", use(F.col("x")).alias("y")).orderBy("i").collect()]


def test_suppression_entries(spark):
    cases = {
        "Dana@Acme.com": ("dana@acme.com", "address"), " acme.com ": ("acme.com", "domain"), "@acme.com": ("acme.com", "domain"), "*@acme.com": ("acme.com", "domain"), "*.acme.com": ("acme.com", "domain"),
        "Dana Lee <dana@acme.com>": ("dana@acme.com", "address"), "mailto:dana@acme.com": ("dana@acme.com", "address"), "dana@acme.com,": ("dana@acme.com", "address"), '"dana@acme.com"': ("dana@acme.com", "address"),
        "Dana <dana@acme.com>, Sam <sam@acme.com>": None, "dana@acme.com, sam@acme.com": None, "dana@acme.com <sam@acme.com>": None, ".@acme.com": (".@acme.com", "address"), "dana@-acme.com": ("dana@-acme.com", "address"),
        "acme": None, "": None, None: None, "two words": None,
    }
    got = column(spark, list(cases), mail.suppression_entry)
    assert [x and (x.value, x.kind) for x in got] == list(cases.values())


def test_profiles(spark):
    urls = ["https://www.linkedin.com/in/Jane-Doe/", "http://linkedin.com/in/x", "linkedin.com/in/x", "https://evil.com/linkedin.com/in/x", "https://www.linkedin.com/company/x", None, "  "]
    assert column(spark, urls, people.strict_profile) == ["https://www.linkedin.com/in/Jane-Doe", None, None, None, None, None, None]
    assert column(spark, urls, people.stored_profile) == ["https://www.linkedin.com/in/Jane-Doe", "https://www.linkedin.com/in/x", "linkedin.com/in/x", "https://evil.com/linkedin.com/in/x", "https://www.linkedin.com/company/x", None, None]
    assert column(spark, urls, people.profile_slug) == ["jane-doe", "x", None, None, None, None, None]
    cases = [("jane-doe", "Jane Doe", True), ("jane-doe-a1b2c3", "Jane Doe", True), ("jane-doe-123", "Jane Doe", True), ("jane", "Jane Doe", False), ("alex-kimberly-jones", "Alex Kim", False), ("jdoe", "Jane Doe", True), ("doejane", "Jane Doe", True), ("josé-núñez", "José Núñez", True), ("kim", "Kim", True), ("kim-lee", "Kim", False), ("dead-beef1", "Beef1 Dead", True), ("x", "", False)]
    df = spark.createDataFrame([(i, f"https://www.linkedin.com/in/{s}", n) for i, (s, n, _) in enumerate(cases)], "i int, u string, n string")
    assert [r.y for r in df.select("i", people.profile_matches_person(F.col("u"), F.col("n")).alias("y")).orderBy("i").collect()] == [c for *_, c in cases]
    assert column(spark, ["see https://linkedin.com/in/Ab and http://www.LinkedIn.com/in/ab/ or https://linkedin.com/in/c-d"], people.profiles_in) == [["https://www.linkedin.com/in/Ab", "https://www.linkedin.com/in/c-d"]]


def test_company_names(spark):
    cases = [("Vellum AI", "vellum.ai", True), ("Sabanto", "epson.com.pe", False), ("Runaway ML", "runwayml.com", True), ("Cogwear", "spotify.com", False), ("Acme", None, False), ("", "acme.com", False), ("Stripe Inc", "stripe-jobs.com", True), ("Figure AI", "ezeedomains.com", False)]
    df = spark.createDataFrame([(i, n, d) for i, (n, d, _) in enumerate(cases)], "i int, n string, d string")
    assert [bool(r.y) for r in df.select("i", people.domain_matches_name(F.col("n"), F.col("d")).alias("y")).orderBy("i").collect()] == [c for *_, c in cases]
    cases = [("Acme AI", "the Acme AI team", True), ("Acme AI", "Acme Analytics", False), ("Acme AI", "acme-ai rocks", True), ("Stripe, Inc.", "at Stripe.", True), ("Acme", "Acme", True), ("Blue River Labs", "labs of the blue river", True), ("Stripe", "stripes", False), ("AI", "AI", False), ("Acme AI", "Acme: AI", False)]
    df = spark.createDataFrame([(i, n, d) for i, (n, d, _) in enumerate(cases)], "i int, n string, d string")
    assert [r.y for r in df.select("i", people.mentions_company(F.col("n"), F.col("d")).alias("y")).orderBy("i").collect()] == [c for *_, c in cases]


def test_roles_names_and_patterns(spark):
    got = column(spark, ["Co-founder & CEO", "Vice President of X", "Talent Partner", "cook", None], lambda c: people.role_and_rank(c, F.lit("jobs")))
    assert [(r.label, r.rank) for r in got] == [("CEO", 0), ("President", 2), ("Partner", 4), ("Careers inbox", 10), ("Careers inbox", 10)]
    assert column(spark, ["Jane Doe, CEO", "our CEO Jane Doe", "nobody", None], lambda c: people.name_from_context(c, F.lit("jane.doe"))) == ["Jane Doe", "Jane Doe", "Jane Doe", "Jane Doe"]
    assert column(spark, ["kim", "info", "k", "a.b"], lambda c: people.name_from_context(F.lit(""), c)) == ["Kim", "", "", ""]
    assert column(spark, ["Jane Doe"], lambda c: people.address_patterns(c, F.lit("@Acme.com"))) == [[f"{x}@acme.com" for x in ("jane.doe", "janedoe", "jdoe", "jane_doe", "jane-doe", "doe.jane")]]
    assert column(spark, ["Jane", ""], lambda c: people.address_patterns(c, F.lit("acme.com"))) == [[], []]
    assert column(spark, ["hello@x.org", "no-reply@x.org", "jane.doe@x.org", "hr.legal@x.org", "a+b@x.org"], people.is_role_local) == [True, True, False, True, True]
    assert column(spark, ["Penn alumni; ML and  robotics / ml | x.", None], people.criteria_terms) == [["Penn alumni", "ML", "robotics"], []]
    ok = column(spark, ["https://x.org", "http://x.org:80/a", "https://x.org:8080", "ftp://x.org", "https://", "x.org"], people.valid_url)
    assert ok == [True, True, False, False, False, False]


def test_message_classes_and_senders(spark):
    rows = [
        ("Jane <jane@x.org>", "Re: delivery failure", None, None, None, None, "reply"), ("MAILER-DAEMON@x.org (Mail)", "", None, None, None, None, "bounce"), ("chr@acme.com", "", None, None, None, None, "reply"), ("HR <hr@acme.com>", "", None, None, None, None, "own"),
        ("a@x.org", "Undeliverable: x", "auto-replied", None, None, None, "bounce"), ("a@x.org", "x", "auto-generated", None, None, None, "auto"), ("a@x.org", "x", "no", None, None, None, "reply"), ("a@x.org", "Out of office", None, None, None, None, "auto"),
        ("a@x.org", "x", None, "multipart/report; report-type = delivery-status", None, None, "bounce"), ("a@x.org", "x", None, None, "<postmaster@x>", None, "bounce"), ("a@x.org", "x", None, None, None, "b@y", "bounce"), ("jane@postmasterlabs.com", "x", None, None, None, None, "reply"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, s string, a string, c string, p string, x string, want string")
    got = df.select("i", "want", mail.message_class(*[F.col(c) for c in "fsacpx"], F.lit("hr@acme.com")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [r.want for r in got]
    headers = ['"Jane Doe" <jane@x.org>', "MAILER-DAEMON@g.com (Mail Delivery System)", "bare@x.org", "Jane Doe", "", None, "<a@b.c>"]
    assert column(spark, headers, mail.sender_address) == ["jane@x.org", "mailer-daemon@g.com", "bare@x.org", "", "", "", "a@b.c"]
    assert column(spark, headers, mail.sender_name) == ["Jane Doe", "Mail Delivery System", "", "Jane Doe", "", "", ""]


def test_quotes_and_markup(spark):
    bodies = ["Thanks!\n\nOn Mon, Jane <j@x.org> wrote:\n> hi", "On Tuesday I left", "> only\n> quote", "ok\n-----Original Message-----\nx", "a\nOn Mon, 3 Jun,\nwrote:\nb", "Yes\n>\nno", None]
    got = column(spark, bodies, mail.split_quote)
    assert [(x.text, x.quoted, x.leading_quote) for x in got] == [
        ("Thanks!", "On Mon, Jane <j@x.org> wrote:\n> hi", False), ("On Tuesday I left", "", False), ("> only\n> quote", "", True), ("ok", "-----Original Message-----\nx", False),
        ("a", "On Mon, 3 Jun,\nwrote:\nb", False), ("Yes\n>\nno", "", False), ("", "", False),
    ]
    pages = ["<head><title>t</title></head><p>Hi&nbsp;&amp; <b a='>'>you</b></p><p>x<br>y</p><script>bad()</script>", "a<!-- > -->b\r\nc\n\n\n\nd  \n", None, "5 < 6"]
    assert column(spark, pages, mail.mail_text) == ["Hi\xa0& you\nx\ny", "a b\nc\n\nd", "", "5 < 6"]
    raw = "&eacute;&#233;&notin;"
    assert column(spark, [raw], mail.mail_text) == [html.unescape(raw)]


def test_windows_follow_clocks(spark):
    """02:00 doesn't exist on the day that clocks go forward: the next opening is the instant they jump to."""
    at = spark.createDataFrame([("2026-03-08 06:30:00",), ("2026-03-09 15:00:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    window = schedule.normal_window(F.lit(True), F.lit("America/New_York"), F.array(F.lit(6), F.lit(0)), F.lit(2), F.lit(5), ["America/New_York"])
    got = [r.o for r in at.select("t", schedule.next_opening(window, F.col("t")).alias("o")).orderBy("t").collect()]
    assert got == [dt.datetime(2026, 3, 8, 7, 0), dt.datetime(2026, 3, 15, 6, 0)]
    assert at.select(schedule.next_opening(schedule.normal_window(F.lit(False), F.lit(""), F.lit(None).cast("array<int>"), F.lit(None).cast("int"), F.lit(None).cast("int"), []), F.col("t")).alias("o")).first().o is None


def test_page_addresses(spark):
    page = '<a href="mailto:Jane@acme.io?subject=x">m</a> kim [at] acme [dot] io, KIM@acme.io. <img src=logo@2x.png> noreply@acme.io &#106;oe&#64;acme.io'
    assert column(spark, [None, ""], text.addresses_in) == [[], []]
    assert column(spark, [page], text.addresses_in)[0][:2] == ["Jane@acme.io", "kim@acme.io"]
    estimates = ["We are a team of 40 people, about 1200 employees; 30+ teammates", "team of 1 people", None, "99999 employees"]
    assert column(spark, estimates, text.employee_estimate) == [1200, None, None, None]
    shells = ['<div id="root"></div>', '<div id="root"></div><a href="mailto:x">', '<div id="root"><script>mailto:</script></div>', "<p>hi", "", None]
    assert column(spark, shells, text.is_script_shell) == [True, False, True, False, True, True]


def test_people_in_payloads(spark):
    payloads = ['[{"name": "Ann", "email": "a@x"}, {"name": "Team", "email": "t@x"}]', '{"a": {"b": [{"fullName": "B", "linkedin_url": "https://LinkedIn.com/in/b"}]}}', "junk", None, '{"name": "C", "email": "none"}']
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, p string")
    assert {r.i: r.n for r in store.people_in_json(df, "i", "p").collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}


def test_reply_outcomes(spark):
    emails = spark.createDataFrame([(1, False, None, None), (2, True, None, None), (3, True, 1, None), (4, True, 1, None), (5, False, None, None), (6, False, None, 1)], "email_id long, has_response boolean, response_verified_at int, bounced_at int")
    verdicts = spark.createDataFrame([(1, "reply", False), (2, "reply", True), (3, "reply", False), (4, "none", False), (6, "none", True)], "email_id long, verdict string, bounced boolean")
    out = replies.checked(emails, verdicts)
    assert {r.email_id: (r.outcome, r.bounced_now) for r in out.collect()} == {1: ("new", False), 2: ("confirmed", True), 3: ("kept", False), 4: ("cleared", False), 5: ("failed", False), 6: ("none", False)}
    assert tuple(replies.check_counters(out).first()) == (6, 1, 1, 1, 1, 1, 0)


def test_union_and_merge(spark):
    one = spark.createDataFrame([(1, 1, "Acme", "https://acme.io"), (1, 2, "Beta.", None), (1, 3, "x" * 81, None)], "query_id long, place long, name string, website string")
    two = spark.createDataFrame([(1, 1, "acme", "https://other.io"), (1, 2, "Gamma", "https://www.acme.io/x"), (1, 3, "Delta", "https://linkedin.com/x"), (1, 4, "Eps", "https://eps.io")], one.schema)
    assert [r.name for r in ingest.union_of_sources(one, two, 10).orderBy("place").collect()] == ["Acme", "Beta", "Eps"]
    rows = spark.createDataFrame(
        [(1, "Ann", "", "", "CEO", "s"), (2, "ann", "a@x.io", "", "", "s"), (3, "Bob", "", "https://linkedin.com/in/bob", "", "s"), (4, "Bob", "b@x.io", "http://www.linkedin.com/in/bob/", "CTO", "s")],
        "candidate_id long, person string, address string, profile string, title string, source string",
    )
    got = {r.candidate_id: (r.person, r.address, r.title) for r in ingest.merged_candidates(rows).collect()}
    assert got == {1: ("ann", "a@x.io", "CEO"), 3: ("Bob", "b@x.io", "CTO")}


def test_page_texts_of_a_site_are_cut(spark):
    pages = spark.createDataFrame([("a", i, "word " * 1500) for i in range(20)] + [("a", 99, "short"), ("b", 1, "x" * 81)], "site string, page_id int, t string")
    got = {r.site: (r.pages, len(r.text)) for r in research.company_pages(pages, "site", F.col("t"), "page_id").collect()}
    assert got == {"a": (5, 24_000), "b": (1, 81)}


def test_affinities_and_scores(spark):
    assert column(spark, ["Penn, then Acme Robotics", "acme", "Acmes"], lambda c: states.affinities(c, ["Penn"], ["Acme", "ab"])) == [["Penn", "Shared: Acme"], ["Shared: Acme"], []]
    rows = spark.createDataFrame([(1, "Head of Sales", ""), (2, "Sales of shoes", None), (3, None, None)], "contact_id long, title string, evidence string")
    asked = spark.createDataFrame([("head of sales", "head of sales", "role"), ("sales", "sales", "role")], "criterion string, term string, place string")
    assert {r.contact_id: (r.score, r.matched) for r in terms.criteria_scores(rows, asked).collect()} == {1: (1.0, "head of sales|sales"), 2: (0.5, "sales"), 3: (0.0, "")}


def test_role_inboxes_are_a_superset_of_words(spark):
    assert re.fullmatch(people.ADDRESS, "a.b+c@x-y.org") and not re.fullmatch(people.ADDRESS, "a@b")
    out = load(spark, SF, "people").select(people.is_role_local(F.col("address")).alias("r"), identity.is_generic_inbox(F.col("address")).alias("g"), F.trim("address").alias("a"))
    assert out.where("g and a <> '' and not r").count() == 0
