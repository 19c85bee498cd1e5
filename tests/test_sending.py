"""Batches under daily limits against a row-by-row loop, running sums, and streams in event time against their twins."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outlake.operators import prefix, sending, windows
from outlake.sources.store import event_stream
from outlake.streaming import timed
from tests.conftest import SF

REASONS = [None] * 6 + ["not sendable", "already delivered", "reconciled", "attempt pending", "replied", "suppressed", "bounced", "no mail acceptance"]


def loop(queue, used, limit):
    """The batches row by row, as they are sent."""
    out, sent = {}, defaultdict(int, used)
    batches = defaultdict(list)
    for row in queue:
        batches[row["sender"], row["day"], row["batch"]].append(row)
    for (sender, day, _), rows in sorted(batches.items()):
        marked, over = set(), False
        for row in sorted(rows, key=lambda r: r["position"]):
            who = (row["recipient"].strip().lower(), row["is_follow_up"])
            if over:
                decision = "daily limit"
            elif row["reason"] in sending.FIRST:
                decision = row["reason"]
            elif who in marked:
                decision = "duplicate"
            elif row["reason"] in sending.UNSETTLED:
                decision = row["reason"]
            elif sent[sender, day] >= limit:
                decision, over = "daily limit", True
            elif row["reason"]:
                decision = row["reason"]
            else:
                decision = row["outcome"]
                if decision in ("sent", "unknown") and who[0]:
                    marked.add(who)
                sent[sender, day] += decision == "sent"
            out[row["email_id"]] = decision
    return out


def test_batches_equal_the_loop(spark):
    """Ten thousand random batches."""
    rng = random.Random(7)
    queue, used, n = [], {}, 0
    for sender in range(400):
        for day in range(5):
            if rng.random() < 0.5:
                used[sender, day] = rng.randrange(4)
            for batch in range(5):
                for position in range(rng.randrange(1, 9)):
                    n += 1
                    who = rng.choice(["a@x.io", " A@x.io", "b@x.io", "c@x.io", ""])
                    queue.append({"sender": sender, "day": day, "batch": batch, "position": position, "email_id": n, "recipient": who, "is_follow_up": rng.random() < 0.3, "reason": rng.choice(REASONS), "outcome": rng.choice(["sent", "sent", "unknown", "refused"])})
    frame = spark.createDataFrame(queue, "sender int, day int, batch int, position int, email_id int, recipient string, is_follow_up boolean, reason string, outcome string")
    before = spark.createDataFrame([(s, d, k) for (s, d), k in used.items()], "sender int, day int, n long")
    got = {r.email_id: r.decision for r in sending.send_batches(frame, before, 5).collect()}
    want = loop(queue, used, 5)
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {} and len(Counter(want.values())) == 13


def test_a_refused_mail_marks_nobody(spark):
    rows = [(1, 0, 0, 1, 1, "a@x", False, None, "refused"), (1, 0, 0, 2, 2, "A@x ", False, None, "unknown"), (1, 0, 0, 3, 3, "a@x", False, None, "sent"), (1, 0, 0, 4, 4, "a@x", True, None, "sent"), (1, 0, 1, 1, 5, "a@x", False, None, "sent")]
    frame = spark.createDataFrame(rows, "sender int, day int, batch int, position int, email_id int, recipient string, is_follow_up boolean, reason string, outcome string")
    none = spark.createDataFrame([], "sender int, day int, n long")
    decide = lambda limit, used=none: [r.decision for r in sending.send_batches(frame, used, limit).orderBy("email_id").collect()]
    assert decide(9) == ["refused", "unknown", "duplicate", "sent", "sent"]
    assert decide(1) == ["refused", "unknown", "duplicate", "sent", "daily limit"]
    assert decide(2, spark.createDataFrame([(1, 0, 2)], none.schema)) == ["daily limit"] * 5
    assert sending.send_batches(frame.limit(0), none, 1).collect() == []


def test_drafts_under_a_daily_limit(spark):
    requests = spark.createDataFrame([(1, 1, 0, 10), (2, 1, 0, 11), (3, 1, 0, 10), (4, 1, 0, 99), (5, 1, 0, 12), (6, 1, 0, 13), (7, 1, 1, 13), (8, 2, 0, 13)], "request_id int, actor int, day int, contact_id int")
    contacts = spark.createDataFrame([(k,) for k in (10, 11, 12, 13)], "contact_id int")
    reasons = spark.createDataFrame([(11, "no email")], "contact_id int, reason string")
    used = spark.createDataFrame([(1, 0, 1), (2, 0, 3)], "actor int, day int, n long")
    got = [r.decision for r in sending.draft_batches(requests, contacts, reasons, used, 3).orderBy("request_id").collect()]
    assert got == ["draft", "no email", "already contacted", "not found", "draft", "daily limit", "draft", "daily limit"]


def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(None if k % 3 == 0 else "hot" if k % 3 == 1 else str(k % 50), k, rng.randrange(5)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "who string, at int, n int").repartition(5)
    out = prefix.running(frame, ["who"], ["at"], total=F.col("n"), count=F.lit(1))
    sums = defaultdict(lambda: (0, 0))
    want = {}
    for who, at, n in rows:
        want[at] = sums[who]
        sums[who] = (sums[who][0] + n, sums[who][1] + 1)
    assert {r.at: (r.total, r['count']) for r in out.collect()} == want
    plan = out._jdf.queryExecution().toString()
    assert "__range" in plan  # windows are over a key's ranges, not over a whole key


# --- event time

START = datetime(2001, 1, 1)


def write_parts(spark, at, parts):
    """Part files read in the order given: files are read by their time, then by name."""
    import os
    import time

    rows = spark.createDataFrame([(0, START, 0, "x")], "event_id long, ts timestamp_ntz, user_id long, event_type string").limit(0)
    os.makedirs(f"{at}/events.parquet")
    for k, part in enumerate(parts):
        frame = spark.createDataFrame(part, rows.schema).coalesce(1)
        frame.write.parquet(f"{at}/tmp{k}")
        name = next(n for n in os.listdir(f"{at}/tmp{k}") if n.endswith(".parquet"))
        os.rename(f"{at}/tmp{k}/{name}", f"{at}/events.parquet/part-{k:05d}.parquet")
        os.utime(f"{at}/events.parquet/part-{k:05d}.parquet", (time.time() - 1000 + k,) * 2)


def interleaved(rng, entities=4, each=60):
    rows = [(k * each + i, START + timedelta(seconds=rng.randrange(0, 900)), k, rng.choice(["purchase", "purchase", "click", "view", "error"])) for k in range(entities) for i in range(each)]
    rng.shuffle(rows)
    return rows


def batch_bursts(spark, rows, seconds):
    frame = spark.createDataFrame(rows, "event_id long, at timestamp_ntz, who long, event string")
    return {r.event_id: (r.in_window, r.retry_after) for r in windows.burst(frame, "who", "at", seconds).collect()}


def test_bursts_for_part_files_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = interleaved(rng)
    orders = {"interleaved": rows, "backwards": sorted(rows, key=lambda r: r[1], reverse=True)}
    for name, order in orders.items():
        write_parts(spark, tmp_path / name, [order[k * 60 : (k + 1) * 60] for k in range(4)])
        got = timed.bursts(event_stream(spark, str(tmp_path / name), files_per_trigger=1), 60, "1 hour")
        assert {r.event_id: (r.in_window, r.retry_after) for r in got.collect()} == batch_bursts(spark, rows, 60)


def test_the_burst_state_holds_one_window(spark, tmp_path):
    """In order, with a second's delay: a window before the watermark (of the batch before), and what has come since."""
    rng = random.Random(4)
    rows = sorted(interleaved(rng, 2, 120), key=lambda r: r[1])
    parts = [rows[k * 24 : (k + 1) * 24] for k in range(10)]
    write_parts(spark, tmp_path / "s", parts)
    out = timed.burst_updates(event_stream(spark, str(tmp_path / "s"), files_per_trigger=1), 60, "1 second").orderBy("batch").collect()
    want = batch_bursts(spark, rows, 60)
    assert {r.event_id: (r.in_window, r.retry_after) for r in out} == want
    batches = sorted({r.batch for r in out})
    assert len(batches) == 10
    span = timedelta(seconds=61)
    most = max(sum(r[2] == who and parts[max(k - 2, 0)][-1][1] - span < r[1] <= parts[k][-1][1] for r in rows) for k in range(1, 10) for who in (0, 1))
    assert max(r.held for r in out if r.batch > batches[0]) <= most < 120


WINDOW = "struct(true as enabled, 'UTC' as zone, array(0, 1, 2, 3, 4) as days, 9 as start_hour, 17 as end_hour)"


def test_due_sweep_equals_its_twin_for_part_files_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, START + timedelta(minutes=rng.randrange(0, 14 * 24 * 60), seconds=i % 60), i % 60, rng.choice(["purchase", "purchase", "purchase", "click", "error", "view"])) for i in range(400)]
    rows.sort(key=lambda r: r[1])
    parts = [rows[k * 50 : (k + 1) * 50] for k in range(8)]
    shuffled = [parts[k] for k in (1, 0, 3, 2, 4, 6, 5, 7)]
    for p in shuffled:
        rng.shuffle(p)
    places = spark.createDataFrame([(k,) for k in range(50)], "entity_id long").selectExpr("entity_id", f"{WINDOW} as window")  # ten have none

    def queued(events):
        return timed.queue_events(events, places, "purchase", ["click", "error"], F.col("created_at") + F.make_dt_interval(hours=(F.col("event_id") % 90).cast("int")))

    frame = spark.createDataFrame(rows, "event_id long, at timestamp, entity_id long, event string").withColumnRenamed("at", "created_at")
    twin = {tuple(r) for r in timed.due_sweep_twin(queued(frame), "6 days").collect()}
    assert {o for _, o, _ in twin} == {"due", "stale"} and len(twin) > 20
    for name, order in (("sorted", parts), ("shuffled", shuffled)):
        write_parts(spark, tmp_path / name, order)
        got = timed.due_sweep(queued(event_stream(spark, str(tmp_path / name), files_per_trigger=1)), "6 days")
        assert {tuple(r) for r in got.collect()} == twin


def test_running_window_without_a_key(spark):
    """The twin of the bursts on the given events, from the library's own table."""
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 5")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy(us).rangeBetween(-(3600 * 10**6 - 1), 0)
    want = {r.event_id: r.n for r in events.select("event_id", F.count("*").over(w).alias("n")).collect()}
    got = windows.burst(events, "user_id", "ts", 3600)
    assert {r.event_id: r.in_window for r in got.collect()} == want
