"""CSV import and export, stream forms and gates with literal rows."""

import pytest
from pyspark.sql import functions as F

from outlake.operators import gates, windows
from outlake.sources import store
from outlake.sources.store import event_stream
from outlake.streaming import streams
from tests.conftest import SF


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "own.csv").write_text("Name,Company,Email,Role\nJane Doe,Acme,j@a.io,CEO\n")
    (tmp_path / "connections.csv").write_text("First Name,Last Name,URL,Company,Position\nJane,Doe,https://x/in/j,Acme,CTO\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    own = store.read_contacts_csv(spark, str(tmp_path / "own.csv"))
    other = store.read_contacts_csv(spark, str(tmp_path / "connections.csv"))
    assert [tuple(r) for r in own.unionByName(other).collect()] == [("Jane Doe", "Acme", "j@a.io", "", "CEO", "", "csv"), ("Jane Doe", "Acme", "", "https://x/in/j", "CTO", "Direct LinkedIn connection", "connections")]
    with pytest.raises(ValueError):
        store.read_contacts_csv(spark, str(tmp_path / "other.csv"))


def test_export_neutralises_formulas(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=1+1"), (2, "plain"), (3, "@x"), (4, None)], "id int, t string")
    store.export_csv(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert dict((int(r.id), r.t) for r in back.collect()) == {1: "'=1+1", 2: "plain", 3: "'@x", 4: None}


def test_due_classes(spark):
    rows = spark.createDataFrame([("2001-01-01 00:00:00",), ("2001-01-04 00:00:00",), ("2001-01-05 00:00:01",), ("2001-01-02 00:00:00",)], "t string")
    now = F.expr("timestamp_ntz '2001-01-05 00:00:00'")
    got = [r[0] for r in rows.select(streams.due_class(F.col("t").cast("timestamp_ntz"), now)).collect()]
    assert got == ["stale", "due", "future", "due"]


def test_burst_leaves_out_what_is_exactly_as_old_as_the_window(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 59), (3, "a", 60), (4, "b", 60)], "event_id int, who string, s int").withColumn("at", F.timestamp_seconds("s"))
    got = {r.event_id: (r.in_window, r.retry_after) for r in windows.burst(rows, "who", "at").collect()}
    assert got == {1: (1, 60.05), 2: (2, 1.05), 3: (2, 59.05), 4: (1, 60.05)}


def test_unknown_acceptance_passes(spark):
    contacts = spark.createDataFrame([(1, "a@x.io"), (2, "a@y.io"), (3, "a@z.io")], "contact_id int, email string")
    domains = spark.createDataFrame([("x.io", False), ("y.io", None)], "domain string, accepts boolean")
    assert {tuple(r) for r in gates.acceptance_gate(contacts, domains).collect()} == {(1, False), (2, True), (3, True)}


def test_events_in_one_file_or_in_part_files(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "parts" / "events.parquet"))
    assert len(list((tmp_path / "parts" / "events.parquet").glob("part-*"))) == 3
    for query in (streams.feed, streams.daily_counts, streams.once_per_actor):
        one, parts = (query(store.event_stream(spark, d)).drop("created_at").collect() for d in (SF, str(tmp_path / "parts")))
        assert one and sorted(one) == sorted(parts)
    assert streams.feed(store.event_stream(spark, str(tmp_path / "parts"))).count() == events.count()


def test_keyed_states_over_many_batches(spark, tmp_path):
    """States that go on from micro-batch to micro-batch equal their batch twins."""
    from pyspark.sql.window import Window as W

    from outlake.streaming import keyed, timed

    every = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 12")
    at = every.select(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    for i in range(4):
        low, high = (at.lo + (at.hi - at.lo) * (i + k) / 4 for k in (0, 1))
        part = every.where((F.col("ts") >= F.lit(low)) & ((F.col("ts") < F.lit(high)) | F.lit(i == 3)))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = lambda: event_stream(spark, str(tmp_path), files_per_trigger=1)
    rows = every.select("event_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("event"))
    us = F.unix_micros("created_at")
    window = W.partitionBy("entity_id").orderBy(us).rangeBetween(-(3600 * 10**6 - 1), 0)
    want = {r.event_id: r.n for r in rows.select("event_id", F.count("*").over(window).alias("n")).collect()}
    assert {r.event_id: r.in_window for r in timed.bursts(stream(), 3600, "400 days").collect()} == want
    last = lambda kinds: {r.entity_id: r.e for r in rows.where(F.col("event").isin(*kinds)).groupBy("entity_id").agg(F.max_by("event", F.struct("created_at", "event_id")).alias("e")).collect()}
    assert {r.entity_id: r.on for r in keyed.opted_out(stream(), ["error"], ["signup", "purchase"]).collect()} == {k: v == "error" for k, v in last(["error", "signup", "purchase"]).items()}
    assert {r.entity_id: r.scheduled for r in keyed.schedules(stream(), "purchase", ["error", "click"]).collect()} == {k: v == "purchase" for k, v in last(["purchase", "error", "click"]).items()}
    got = {r.entity_id: (r.has_response, r.bounced_at) for r in keyed.reply_states(stream(), "click", "view", "purchase").collect()}
    first = {r.entity_id: r.t for r in rows.where("event = 'purchase'").groupBy("entity_id").agg(F.min("created_at").alias("t")).collect()}
    said = last(["click", "view"])
    assert got == {k: (said.get(k) == "click", first.get(k)) for k in said.keys() | first.keys()}


def test_a_list_that_cannot_be_read_lets_nothing_pass(spark):
    from pyspark.errors import StreamingQueryException

    from outlake.streaming import keyed

    calls = []

    def blocked():
        calls.append(1)
        if len(calls) > 1:  # the schema is asked for first
            raise OSError("unreadable")
        return spark.createDataFrame([(1,)], "entity_id long")

    with pytest.raises((StreamingQueryException, OSError)):
        keyed.unsuppressed(event_stream(spark, SF), blocked)
