"""Identifiers and names that belong to one row, against loops over the rows."""

import random

from pyspark.sql import functions as F

from outlake.operators import claims, ingest


def test_greedy_rows_equal_a_loop(spark):
    """Random conflict graphs, and a chain that alternates its keys."""
    rng = random.Random(11)
    rows = [(i, rng.choice([None, *range(60)]), rng.choice([None, None, *range(40)])) for i in range(400)]
    rows += [(1000 + i, 100 + i // 2, 100 + (i + 1) // 2) for i in range(12)]
    seen, want = (set(), set()), {}
    for i, *keys in rows:
        want[i] = not any(k is not None and k in s for k, s in zip(keys, seen, strict=True))
        if want[i]:
            for k, s in zip(keys, seen, strict=True):
                s.add(k)
    frame = spark.createDataFrame(rows, "i int, a int, b int").repartition(3)
    got, rounds = claims.greedy(frame, ["a", "b"], "i")
    assert {r.i: r.stays for r in got.collect()} == want and 2 <= rounds <= 8
    none, rounds = claims.greedy(frame.limit(0), ["a", "b"], "i")
    assert none.count() == 0 and rounds == 1


def loop(stored, batch):
    """Inserts one after another under two unique indexes."""
    rows = [(e.strip().lower(), u, ("stored", i), c) for i, c, e, u in sorted(stored, key=lambda r: r[0])]
    out = {}
    for i, company, e, u in batch:
        e = e.strip().lower()
        by = lambda k, v: next((r for r in rows if v and r[k] == v), None)  # noqa: E731, B023
        found = by(0, e) or by(1, u)
        out[i] = (found is None, found and found[2], found and found[3])
        if found is None:
            rows.append((e, u, ("batch", i), company))
    return out


def test_claims_equal_inserts_one_after_another(spark):
    rng = random.Random(12)
    url = lambda k: f"https://www.linkedin.com/in/p{k}" if k else ""
    stored = [(i, i % 5, f"s{i}@x.io", url(i if i % 2 else 0)) for i in range(1, 30)]
    batch = [(i, rng.randrange(5), rng.choice(["", f"s{rng.randrange(1, 60)}@x.io", f" S{rng.randrange(1, 60)}@X.io", f"n{rng.randrange(25)}@x.io"]), url(rng.choice([0, 0, rng.randrange(1, 90)]))) for i in range(300)]
    schema = "{} int, company_id int, address string, profile string"
    out = claims.claimed(spark.createDataFrame(batch, schema.format("candidate_id")), spark.createDataFrame(stored, schema.format("contact_id"))).collect()
    got = {r.candidate_id: (r.inserted, ("stored", r.contact_id) if r.contact_id is not None else ("batch", r.by_candidate) if r.by_candidate is not None else None, r.owner_id) for r in out}
    assert got == loop(stored, batch) and any(v[1] and v[1][0] == "batch" for v in got.values())


def test_the_second_candidate_names_the_first(spark):
    """One address twice in a batch; a row that loses its address still leaves its profile to others."""
    url = "https://www.linkedin.com/in/"
    batch = spark.createDataFrame([(1, 7, "a@x.io", ""), (2, 7, "A@x.io", url + "q"), (3, 8, "", url + "q"), (4, 8, "b@x.io", url + "q/"), (5, 9, "", "")], "candidate_id int, company_id int, address string, profile string")
    none = spark.createDataFrame([], "contact_id int, company_id int, address string, profile string")
    assert [(r.candidate_id, r.inserted, r.by_candidate) for r in claims.claimed(batch, none).orderBy("candidate_id").collect()] == [(1, True, None), (2, False, 1), (3, True, None), (4, False, 3), (5, True, None)]
    got = {r.candidate_id: tuple(r)[1:] for r in claims.attached(batch, none).collect()}
    assert got == {
        1: ("attach", True, False, True, None),
        2: ("enrich", True, False, False, "profile"),
        3: ("attach", False, True, True, None),
        4: ("enrich", False, True, False, None),
        5: ("nothing", False, False, False, None),
    }
    decided = spark.createDataFrame([(1, "accept"), (2, "accept"), (3, "accept_profile_only"), (4, "suppressed")], "candidate_id int, decision string")
    outcome = claims.import_outcomes(batch, decided, none)
    assert {tuple(r) for r in outcome.collect()} == {(1, "added"), (2, "duplicate"), (3, "added"), (4, "invalid")}


def test_union_of_sources_equals_the_loop(spark):
    rng = random.Random(13)
    rows = [(q, s, p, f"Name {rng.randrange(25)}", rng.choice([None, f"https://d{rng.randrange(25)}.com/x"])) for q in range(4) for s in (1, 2) for p in range(60)]
    want = set()
    for q in range(4):
        names, sites, kept = set(), set(), []
        for _, _, _, name, site in sorted(r for r in rows if r[0] == q):
            domain = site and site.split("/")[2]
            if name.lower() in names or (domain and domain in sites):
                continue
            names.add(name.lower())
            sites |= {domain} if domain else set()
            kept.append((name, domain))
        want |= {(q, i + 1, *x) for i, x in enumerate(kept[:15])}
    frame = spark.createDataFrame(rows, "query_id int, source int, place int, name string, website string")
    halves = [frame.where(F.col("source") == k).drop("source") for k in (1, 2)]
    assert {tuple(r) for r in ingest.union_of_sources(*halves, 15).collect()} == want


def test_roots_of_chains_and_cycles(spark):
    """Long chains, cycles with tails, missing parents and rows that follow themselves, against a walk."""
    from outlake.operators import followups

    rng = random.Random(14)
    parent = {i: i - 1 for i in range(1, 300)} | {1000 + i: 1000 + (i + 1) % 70 for i in range(70)} | {2000: 2001, 2001: 2000, 2002: 2002, 2003: 9999}
    parent |= {3000 + i: rng.choice([1000 + rng.randrange(70), 3000 + rng.randrange(40), 2000]) for i in range(40)}
    rows = [(i, p, True) for i, p in parent.items()] + [(0, None, False)]

    def walk(i):
        seen = [i]
        while (p := parent.get(seen[-1])) is not None and p not in seen and (p in parent or p == 0):
            seen.append(p)
        return seen[-1]

    frame = spark.createDataFrame(rows, "email_id int, original_email_id int, is_follow_up boolean").withColumn("follow_up_step", F.lit(0))
    assert {r.email_id: r.root_id for r in followups.roots(frame).collect()} == {i: walk(i) for i, _, _ in rows}
