"""Rules with literal rows: what the derived views don't hold."""

from pyspark.sql import functions as F

from outlake.functions import identity
from outlake.operators import analytics, duplicates, followups, suppression


def values(spark, fn, rows):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_canonical_mailbox(spark):
    got = values(spark, identity.canonical_mailbox, ["D.a+x@GoogleMail.com", "a.b+t@acme.com", "+tag@acme.com", "nobody", None, "d.a@gmail.com"])
    assert got == ["da@gmail.com", "a.b@acme.com", "+tag@acme.com", "nobody", "", "da@gmail.com"]


def test_registered_domain(spark):
    got = values(spark, identity.registered_domain, ["https://www.foo.co.uk/x", "a.b.example.com", "http://u:p@h.org:80/a", "localhost", "", None])
    assert got == ["foo.co.uk", "example.com", "h.org", "localhost", None, None]


def test_domain_chain(spark):
    assert values(spark, identity.domain_chain, ["a.b.c", "x", ""]) == [["a.b.c", "b.c"], ["x"], []]


def test_name_tokens_fold_accents(spark):
    assert values(spark, identity.name_tokens, ["José O'Brien Jr.", "Zoë Ĝ", None]) == [["jose", "obrien"], ["zoe"], []]


def test_email_matches_person(spark):
    rows = [("jane.doe@x.io", "Jane Doe", True), ("doe.jane@x.io", "Jane Doe", True), ("jdoe@x.io", "Jane Doe", True), ("doe@x.io", "Jane Doe", False), ("hello@x.io", "Hello Kitty", False), ("john.smith@x.io", "Jane Smith", False), ("kim@x.io", "Kim", True), ("shannon@x.io", "Ann", False), ("", "Ann", False)]
    df = spark.createDataFrame(rows, "e string, n string, want boolean")
    assert df.where(identity.email_matches_person(F.col("e"), F.col("n")) != F.col("want")).count() == 0


def test_quartiles_take_the_upper_middle(spark):
    rows = [(f"2001-01-01 0{h}:00:00",) for h in (1, 2, 3, 4)]
    facts = spark.createDataFrame(rows, "r string").selectExpr("timestamp_ntz '2001-01-01 00:00:00' as sent_at", "cast(r as timestamp_ntz) as response_at", "true as has_response", "timestamp_ntz '2001-01-02 00:00:00' as response_verified_at")
    r = analytics.hours_to_reply(facts).first()
    assert (r["count"], r.p25, r.median, r.p75, r.excluded) == (4, 2.0, 3.0, 3.0, 0)
    empty = analytics.hours_to_reply(facts.limit(0)).first()
    assert (empty["count"], empty.median, empty.excluded) == (0, None, 0)


def test_rate_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(1, 16), (0, 0), (3, 16)], "a int, b int").select(analytics.rate_of(F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == [6.2, None, 18.8]


def test_address_beats_domain_and_the_most_specific_wins(spark):
    people = spark.createDataFrame([(1, "Dana+x@sub.acme.com"), (2, "sam@sub.acme.com"), (3, "x@notacme.com"), (4, ""), (5, None)], "contact_id int, email string")
    entries = spark.createDataFrame([(1, "domain", "acme.com", 1), (2, "domain", "sub.acme.com", 2), (3, "address", "dana@sub.acme.com", 0)], "suppression_id int, kind string, value string, at int")
    entries = entries.withColumn("created_at", F.timestamp_seconds("at"))
    assert {(r.contact_id, r.suppression_id) for r in suppression.match(people, entries, "contact_id", "email").collect()} == {(1, 3), (2, 2)}


def test_roots_stop_at_cycles_and_missing_parents(spark):
    rows = [(1, None, False), (2, 1, True), (3, 2, True), (4, 99, True), (5, 6, True), (6, 5, True)]
    emails = spark.createDataFrame(rows, "email_id int, original_email_id int, is_follow_up boolean")
    assert dict(followups.roots(emails).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 6, 6: 5}


def test_roots_of_long_chains(spark):
    rows = [(1, None, False)] + [(i, i - 1, True) for i in range(2, 14)] + [(i, 20 + (i - 19) % 12, True) for i in range(20, 32)]
    emails = spark.createDataFrame(rows, "email_id int, original_email_id int, is_follow_up boolean")
    want = {i: 1 for i in range(1, 14)} | {i: 20 + (i - 21) % 12 for i in range(20, 32)}
    assert dict(followups.roots(emails).collect()) == want


def test_keepers_and_repointing(spark):
    rows = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "b", False), (4, None, True), (5, None, True)], "id int, k string, v boolean")
    moved = duplicates.keepers(rows, "id", [F.col("k")], [F.when(F.col("v"), 0).otherwise(1)])
    assert {tuple(r) for r in moved.collect()} == {(1, 2), (2, 2)}
    assert {r.id for r in duplicates.collapse(rows, moved, "id").collect()} == {2, 3, 4, 5}
    assert [r.id for r in duplicates.repoint(rows.select("id"), moved, "id").orderBy("id").collect()] == [2, 2, 3, 4, 5]
