"""Many terms in many texts, quotes in pages, nearest following rows, and pages of a stored order."""

import random
import re

from pyspark.sql import functions as F

from outlake.operators import pages, prefix, terms

VOCABULARY = [f"w{k}" for k in range(300)] + ["of", "ml", "cto", "it", "head", "sales"]


def words(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def plain_found(texts, asked):
    out = set()
    for text_id, role, evidence in texts:
        r, both = words(role), words(f"{role or ''} {evidence or ''}")
        for term_id, term, place in asked:
            w = words(term)
            telling = [x for x in w if len(x) >= 3 or x in terms.SHORT]
            run = lambda seen, w=w: any(seen[i : i + len(w)] == w for i in range(len(seen) - len(w) + 1))
            if w and (all(x in r for x in telling) if place == "role" and telling else run(r) if place == "role" else run(both)):
                out.add((text_id, term_id))
    return out


def test_many_terms_in_many_texts(spark):
    rng = random.Random(21)
    some = lambda lo, hi: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(lo, hi)))
    texts = [(i, rng.choice([None, some(1, 6), some(1, 6).replace(" ", " - ").upper()]), rng.choice([None, some(0, 12)])) for i in range(200)]
    asked = [(i, rng.choice([some(1, 4), "of it", "It", "CTO", "", "nowhere w1"]), rng.choice(["role", "education"])) for i in range(600)]
    frame = spark.createDataFrame(texts, "text_id int, role string, evidence string")
    got = terms.found_terms(frame, spark.createDataFrame(asked, "term_id int, term string, place string"))
    want = plain_found(texts, asked)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50


def test_the_plan_does_not_grow_with_the_terms(spark):
    frame = spark.createDataFrame([(1, "head of sales w7", None)], "text_id int, role string, evidence string")
    size = lambda n: len(terms.found_terms(frame, spark.range(n).selectExpr("id as term_id", "concat('w', id) as term", "'role' as place"))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(10_000) - size(10)) < 200
    asked = spark.range(10_000).selectExpr("id as term_id", "concat('w', id) as term", "'role' as place")
    assert [tuple(r) for r in terms.found_terms(frame, asked).collect()] == [(1, 7)]


def test_scores_name_criteria_once(spark):
    people = spark.createDataFrame([(1, "VP, Sales (Head of Sales)", "studied at Penn State"), (2, "Headsales", "U Penn 1999"), (3, None, None)], "contact_id int, title string, evidence string")
    asked = spark.createDataFrame([("sales lead", "head of sales", "role"), ("penn", "u penn", "education"), ("penn", "penn state", "education"), ("vp", "VP", "role")], "criterion string, term string, place string")
    got = {r.contact_id: tuple(r)[1:] for r in terms.criteria_scores(people, asked).collect()}
    assert got == {1: (1.0, "penn|sales lead|vp", True), 2: (0.333, "penn", True), 3: (0.0, "", False)}


def test_grounded_records(spark):
    page = "Ana Doe leads  the\nRobotics group. Write to Ana.Doe@acme.org, see https://acme.org/team."
    pages_ = spark.createDataFrame([(1, page), (2, None)], "page_id int, text string")
    good = ("ana.doe@ACME.org", "ana doe LEADS the robotics", "https://acme.org/team")
    rows = [(1, 1, *good), (2, 1, "bea@acme.org", *good[1:]), (3, 1, good[0], "leads the", ""), (4, 1, good[0], "Ana Doe leads the chemistry group", ""), (5, 1, *good[:2], "https://other.org"), (6, 2, *good), (7, 9, *good), (8, 1, good[0], good[1], None), (9, 1, None, good[1], None)]
    rows += [(100 + k, 1, *good) for k in range(600)]  # more than go at once
    records = spark.createDataFrame(rows, "record_id int, page_id int, email string, quote string, source_url string")
    got = {r.record_id: r.email for r in terms.grounded(records, pages_).collect()}
    assert got == dict.fromkeys([1, 8, *range(100, 700)], "Ana.Doe@acme.org")


def test_nearest_following_rows_of_a_hot_key(spark):
    rng = random.Random(22)
    rows = [(rng.choice(["hot", "hot", "x", None]), i, rng.choice([None, None, None, i])) for i in range(2000)]
    want, after = {}, {}
    for who, at, v in reversed(rows):
        if v is not None:
            after[who] = v
        want[at] = after.get(who)
    frame = spark.createDataFrame(rows, "who string, at int, v int").repartition(6)
    out = prefix.following(frame, ["who"], ["at"], F.col("v"))
    assert {r.at: r.next for r in out.collect()} == want


def test_an_attempt_takes_the_message_that_follows_without_pairs(spark):
    """A campaign's one subject to a shared inbox: as many attempts as messages, and no product of them."""
    from outlake.operators import states

    n = 3000
    emails = spark.range(n).selectExpr("id as email_id", "'Team@x.io' as recipient_email", "'Hi' as subject", "timestamp_seconds(1000 * id) as send_attempted_at", "'draft' as status", "cast(null as string) as gmail_message_id", "cast(null as timestamp) as sent_at")
    sent = spark.range(n).selectExpr("concat('m', id) as message_id", "'team@X.io' as recipient", "'Hi' as subject", "timestamp_seconds(1000 * id - case when id % 2 = 0 then 30 else 90 end) as at")
    out = states.reconciled(emails, sent)
    assert "Join" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "subject" in x and "recipient" in x)
    got = {r.email_id: r.message_id for r in out.collect()}
    assert got == {i: f"m{i}" if i % 2 == 0 else (f"m{i + 1}" if i + 1 < n else None) for i in range(n)}


def test_pages_of_a_stored_order(spark):
    rng = random.Random(23)
    rows = [(i, rng.choice("abcdef") * rng.randrange(1, 3)) for i in range(1003)]
    frame = spark.createDataFrame(rows, "id int, name string").repartition(5)
    index = pages.stored(frame, [F.col("name"), -F.col("id")], 25)
    order = sorted(rows, key=lambda r: (r[1], -r[0]))
    assert index.total == 1003 and index.pages == 41
    for number, real in ((1, 1), (7, 7), (41, 41), (99, 41), (0, 1), (-3, 1)):
        got = index.page(number).collect()
        assert [(r.id, r.name) for r in got] == order[(real - 1) * 25 : real * 25] and [r.place for r in got] == list(range((real - 1) * 25 + 1, (real - 1) * 25 + len(got) + 1))
    plan = index.page(7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "GreaterThan" not in plan
    empty = pages.stored(frame.limit(0), [F.col("id")], 25)
    assert empty.pages == 1 and empty.page(1).collect() == []
