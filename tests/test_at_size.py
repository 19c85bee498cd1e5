"""What larger tables need: plans that stay short, values computed once, joins that don't grow with the square of a group."""

import random

from pyspark.sql import functions as F

from outlake.functions import people
from outlake.operators import ingest, states, terms
from outlake.plans.views import load
from outlake.sources import store
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_plan_of_the_gate_is_short(spark):
    gate = ingest.gate(load(spark, SF, "people"), load(spark, SF, "suppressions"))
    assert len(plan(gate)) < 1_000_000


def test_counters_judge_rows_once(spark):
    rows = spark.createDataFrame([(i, d, None) for i, d in enumerate(["suppressed"] * 7 + ["accept"] * 2)], "contact_id long, decision string, warning string")
    judged = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            judged.add(len(part))
            yield part

    out = ingest.import_counters(rows.mapInPandas(seen, rows.schema))
    assert {tuple(r) for r in out.select("decision", "n", "warnings", "samples").collect()} == {("suppressed", 7, 0, "0,1,2,3,4"), ("accept", 2, 0, "")}
    assert judged.value == 9


def test_a_name_is_taken_apart_once_for_all_its_patterns(spark):
    names = spark.createDataFrame([("Zoë Núñez", "Acme.com"), ("Ana", "x.org"), (None, None)], "name string, domain string")
    made = names.select(people.address_patterns(F.col("name"), F.col("domain")).alias("x"))
    assert [r.x for r in made.collect()] == [[f"{x}@acme.com" for x in ("zoe.nunez", "zoenunez", "znunez", "zoe_nunez", "zoe-nunez", "nunez.zoe")], [], []]
    assert plan(made).count("name#") <= 3  # column, its source and one use


def test_few_files_are_dealt_out(spark):
    rows = store.spread(load(spark, SF, "nation"))
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert rows.count() == 25


def test_profiles_meet_the_names_that_they_share_a_key_with(spark):
    rng = random.Random(31)
    words = ["ana", "bob", "Zoë", "doe", "beef1", "dead", "facade", "kim", "12", "12345", "a1b2c3", "anadoe", "adoe", "PhD", "x"]
    some = lambda lo, hi, sep: sep.join(rng.choice(words) for _ in range(rng.randrange(lo, hi)))
    persons = spark.createDataFrame([(rng.choice([1, 2, None]), i, rng.choice([None, some(0, 4, " ")])) for i in range(400)], "page_id int, contact_id int, person string")
    links = spark.createDataFrame([(rng.choice([1, 2, None]), i, rng.choice([None, "https://example.org/in/ana-doe", "https://www.linkedin.com/in/" + some(0, 4, rng.choice("-_"))])) for i in range(300)], "page_id int, place int, url string")
    want = persons.join(links, "page_id").where(people.profile_matches_person(F.col("url"), F.col("person"))).groupBy("page_id", "contact_id").agg(F.min_by("url", "place").alias("url"))
    got = states.linked_profiles(persons, links)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 30
    assert "translate" not in plan(got)  # names and slugs were taken apart before they met


def test_texts_that_repeat_are_not_broadcast(spark):
    texts = spark.range(50_000).selectExpr("id as text_id", "concat('head of sales w', id % 5) as role", "'met at a fair' as evidence")
    asked = spark.range(3_000).selectExpr("id % 3 as term_id", "concat('w', id % 3) as term", "'role' as place")
    found = terms.found_terms(texts, asked)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 30_000


def test_criteria_given_often_are_looked_up_once(spark):
    texts = spark.createDataFrame([(1, "head of sales", None), (2, None, None)], "contact_id int, title string, evidence string")
    asked = spark.range(500).selectExpr("'s' as criterion", "'sales' as term", "'role' as place")
    seen, found = [], terms.found_terms
    terms.found_terms = lambda at, named: seen.append(named.count()) or found(at, named)
    try:
        got = terms.criteria_scores(texts, asked).collect()
    finally:
        terms.found_terms = found
    assert seen == [1] and {tuple(r) for r in got} == {(1, 1.0, "s", False), (2, 0.0, "", False)}


def test_quotes_stand_in_their_page_whatever_their_case(spark):
    page = "Die Straße nach Süden führt  weiß Gott zur Küste, ΟΔΟΣ ΠΡΟΣ ΒΟΡΡΑ. Write to Ana@acme.org."
    quotes = ["DIE STRASSE NACH SÜDEN FÜHRT", "die straße nach süden führt", "STRAẞE NACH SÜDEN FÜHRT", "FÜHRT WEISS GOTT ZUR KÜSTE", "οδος προς βορρα. write", "die strase nach süden führt", "Straße nach Süden f"]
    records = spark.createDataFrame([(i, 1, "ana@acme.org", q, "") for i, q in enumerate(quotes)], "record_id int, page_id int, email string, quote string, source_url string")
    got = terms.grounded(records, spark.createDataFrame([(1, page)], "page_id int, text string"))
    assert {tuple(r) for r in got.collect()} == {(i, "Ana@acme.org") for i in range(5)}
