"""Near-dedup, line dedup and embedding dedup against brute force, and their edge cases."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlake.llm.embedding_dedup import near_duplicates as near_vectors
from outlake.llm.line_dedup import line_dedup
from outlake.llm.near_dedup import near_dedup, near_duplicates
from tests.conftest import SF

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lowered(text):
    return WORD.findall((text or "").encode().lower())


def shingles(text):
    w = lowered(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    at = classes(ids, links)
    return {(i, len(sets[i]), at[i], at[i] == i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {tuple(r) for r in near_duplicates(docs).collect()}
    assert got == brute_near([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_near_duplicates_in_large_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            w[k] = f"x{rng.integers(0, 5)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in near_duplicates(docs).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "one"), (None, "one two"), (7, "a b c d e"), (8, "a b c d e"), (8, "a b c d e")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, component long, id long")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 1, None, True), (7, 1, 7, True), (8, 1, 7, False), (8, 1, 7, False)]
    assert got == sorted(want, key=str)
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, None, 7]))
    assert near_duplicates(docs.limit(0)).count() == 0


def brute_lines(rows, percent=85, least=5):
    lines = []
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").lower().split("\n")):
            s = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            if len(s) >= least:
                lines.append(((i, k), s))
    return {w for n, (w, s) in enumerate(lines) if any(100 * len(s & t) >= percent * len(s | t) for _, t in lines[:n])}


def test_line_dedup_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    gone = brute_lines(rows)
    assert len(gone) > 20
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup(docs).select("doc.*", "lines.*").collect()}
    for i, text in rows:
        lines = text.split("\n")
        assert got[i] == ("\n".join(x for k, x in enumerate(lines) if (i, k) not in gone), len(lines), sum(d == i for d, _ in gone))


def test_line_dedup_edges(spark):
    line = "the same words in this line"
    rows = [(2, f"{line}\nkeep"), (1, f"head\n{line}"), (3, None), (4, ""), (None, line), (5, f"{line.upper()}\n{line}"), (6, "a b c d"), (7, "a b c d")]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, line int, hash string")
    out = line_dedup(docs.withColumns({c: F.lit(1) for c in ("id", "gone", "l", "made", "c0", "n_lines", "__gone")}))
    got = {r.doc.doc_id: (r.doc.text, r.lines.n_removed, r.doc.line, r.doc.hash) for r in out.collect()}
    assert got == {2: ("keep", 1, 9, "x"), 1: (f"head\n{line}", 0, 9, "x"), 3: (None, 0, 9, "x"), 4: ("", 0, 9, "x"), None: (line, 0, 9, "x"), 5: ("", 2, 9, "x"), 6: ("a b c d", 0, 9, "x"), 7: ("a b c d", 0, 9, "x")}
    assert line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_of_long_lines_and_filters(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, f"{long} more\nshort"), (3, "x\t y\r z \x0b\x0c a b"), (4, "Z y x b A"), (5, "\n" * 5_000 + "one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_lines, r.n_removed) for r in line_dedup(docs).where("lines.n_removed >= 0 and doc.text is not null and length(doc.text) >= 0").select("doc.doc_id", "lines.*").collect()}
    assert got == {(1, 1, 0), (2, 2, 1), (3, 1, 0), (4, 1, 1), (5, 5001, 0)}


def test_short_lines_go_where_every_line_is_asked_for(spark):
    rows = [(1, "Contents\nSee also\n---"), (2, "See also\nother words\n---"), (3, "contents"), (4, None), (5, "see  also")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 2):
        gone = brute_lines(rows, least=least)
        assert len(gone) == {1: 4, 2: 2}[least]
        got = {r.doc_id: r.text for r in line_dedup(docs, min_tokens=least).select("doc.*").collect()}
        assert got == {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_prefix_join_reads_one_exchange(spark):
    """Both sides of the self-join need the same columns, so the prefixes are exploded and shuffled once."""
    from outlake.llm import line_dedup as ld

    classes = spark.createDataFrame(
        [(1, 0, 5, i, i, 0, [1, 2]) for i in range(4)], "set long, map long, n int, id long, hash long, line int, prefix array<int>"
    )
    settled = spark.createDataFrame([(3, 3, 0)], "id long, hash long, line int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = ld._candidates(classes, settled, 85)
        assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
        assert {(r.a.id, r.b.id) for r in pairs.collect()} == {(0, 1), (0, 2), (1, 2)}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rarity_is_counted_on_saved_tokens(spark):
    """The texts are split into words once: the levels need the tokens alone."""
    from outlake.llm import line_dedup as ld

    rare, common = 3 << ld.REST, 2 << ld.REST
    tokens = spark.createDataFrame([([common],)] * 4_000 + [([common, rare],)], "t array<long>")
    levels = ld._levels(tokens)
    got = spark.range(1).select(*[F.lit(h).bitwiseXOR(F.get(levels, F.lit(h >> ld.REST))).alias(c) for c, h in (("rare", rare), ("common", common))]).first()
    assert got.rare < got.common

    rows = [(1, "one two two THREE"), (2, "\n")]
    texts = spark.createDataFrame(rows, "id long, text string").withColumn("hash", F.lit(0).cast("long"))
    got = {(r.id, r.line): (r.n, r.least, r.most, r.t) for r in ld._token_rows(texts).collect()}
    t = sorted(r[0] for r in spark.createDataFrame([("one",), ("two",), ("three",)], "w string").select(F.xxhash64("w")).collect())
    assert got == {(1, 0): (3, t[0], t[-1], t), (2, 0): (0, 0, 0, []), (2, 1): (0, 0, 0, [])}


def test_lines_read_back_keep_their_words(spark):
    """Candidates are read back line by line: letters whose lower case depends on what follows, blanks, repeated rows."""
    words = [f"\u03a3\u039f\u03a3{i}" if i % 3 else f"\u039f\u0394\u039f\u03a3" + "x" * i for i in range(20)] + ["\u0130\u039f\u03a3"]
    rows = [(1, "head\n" + " ".join(words)), (2, "\t".join(words[1:]).lower() + "\nother words stand in this line"), (3, "\n\n" + "  ".join([*words[:-1], "\u039f\u03a3"]))]
    rows += [(4, "other words stand in this very line of nine"), (5, rows[1][1]), (5, rows[1][1]), (6, " ".join(words[:10]))]
    lower = {i: t.replace("\u0130", "i\u0307") for i, t in rows}
    gone = brute_lines(list(lower.items()))
    assert len(gone) == 4
    got = [(r.doc_id, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.*").collect()]
    assert sorted(got) == sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows)


def test_lines_with_every_blank_and_rare_and_common_words(spark):
    rng = np.random.default_rng(5)
    words = [f"W{i}" for i in range(40)] + [f"\u00c9t{i}" for i in range(40)]
    odds = 1 / np.arange(1, 81)
    base = [list(rng.choice(words, 24, p=odds / odds.sum())) for _ in range(30)]
    rows = []
    for i in range(120):
        w = list(base[i % 30])
        for k in rng.choice(24, rng.integers(0, 4), replace=False):
            w[k] = str(rng.choice(words))
        rows.append((i, "\n".join(rng.choice([" ", "\t", "\x0b", "\x0c", "\r", "  "]).join(x) for x in (w, w[:4], w[::-1]))))
    gone = brute_lines(rows)
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.*").collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows} and len(gone) > 100


def test_vectors_of_more_than_a_thousand_components(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 1500))
    near = base + rng.normal(size=base.shape) * np.linspace(0.15, 0.25, 12)[:, None]  # cosines on both sides of 0.98
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(np.vstack([base, near, base[:3] * 7]))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    assert {tuple(r) for r in near_vectors(vectors).collect()} == brute_vectors(rows)


def brute_vectors(rows, threshold=0.98):
    def unit(v):
        return v if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) else None

    good = {i: np.array(v, float) for i, v, label in rows if i is not None and label is not None and unit(v) is not None}
    label = {i: x for i, _, x in rows}
    ids, links = sorted(good), []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if label[a] == label[b] and len(good[a]) == len(good[b]):
                x, y = (v / np.abs(v).max() for v in (good[a], good[b]))
                if (x * y).sum() / (math.sqrt((x * x).sum()) * math.sqrt((y * y).sum())) >= threshold:
                    links.append((a, b))
    at = classes([i for i, _, _ in rows], links)
    return {(i, sum(i in p for p in links), at[i], at[i] == i) for i, _, _ in rows}


def test_vectors_match_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert {tuple(r) for r in near_vectors(df).collect()} == brute_vectors(rows)


@pytest.mark.parametrize("tiles", [1, 3])
def test_vectors_close_to_the_threshold_and_edges(spark, tiles, monkeypatch):
    from outlake.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "TILE", 1 if tiles > 1 else 1024)
    monkeypatch.setattr(embedding_dedup, "TILES", tiles)
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = []
    for i in range(120):
        v = base + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.16, 1.0]) * np.linalg.norm(base) / 4
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(200, rows[0][1], None), (201, None, 0), (202, [0.0] * 16, 0), (203, [math.nan] * 16, 0), (204, [math.inf] + [1.0] * 15, 0), (205, rows[0][1][:8], 0), (206, [None] * 16, 0), (207, [], 0), (208, rows[0][1], 0)]
    rows += [(k, [x * s for x in rows[0][1][:15]] + [0.0], 5) for k, s in ((210, 1e200), (211, 1e200), (212, 1e-200), (213, 1e-200), (214, 1e-300))]
    df = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<double>, label int, tile string")
    got = {tuple(r) for r in near_vectors(df).collect()}
    assert got == brute_vectors(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_signatures_of_large_sets_stay_apart():
    """Unrelated sets of a million shingles share no band, and a near copy shares most coordinates."""
    from outlake.llm.shingles import band_keys, signature

    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**64, 1_000_000, dtype=np.uint64)) for _ in range(3)]
    near = np.unique(np.concatenate((sets[0][50_000:], rng.integers(0, 2**64, 50_000, dtype=np.uint64))))
    signed = [signature(s) for s in [*sets, near]]
    keys = [set(band_keys(s).tolist()) for s in signed]
    assert not keys[0] & keys[1] and not keys[0] & keys[2] and not keys[1] & keys[2]
    assert keys[0] & keys[3] and 0.8 < (signed[0] == signed[3]).mean() < 0.97
