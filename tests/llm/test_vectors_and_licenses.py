"""Whitening, vector codes and licence scans: brute force and edges."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from outlake.llm import license_scan, vector_codes, vectors, whitening
from outlake.llm.queries import op11_embedding_whitening, op12_vector_codes, op13_license_scan
from tests.conftest import SF

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, id string, v string, n int"


def odd_vectors(spark, good):
    """``good`` vectors, and all that is dropped; the other columns have names that clash."""
    bad = [(90, None, 1), (91, [], 1), (92, [1.0, None, 0.0, 0.0], 2), (93, [NAN, 0.0, 0.0, 0.0], None), (94, [INF, 0.0, 0.0, 0.0], 2), (95, [1.0] * 5, 2)]
    rows = [(i, v, label, "x", "y", 0) for i, v, label in [*good, *bad]]
    return spark.createDataFrame(rows, SCHEMA)


def embeddings():
    table = pq.read_table(f"{SF}/embeddings.parquet")
    return table["vec_id"].to_pylist(), np.array(table["embedding"].to_pylist(), np.float64), table["label"].to_pylist()


# --- whitening


def test_whitening_equals_a_dense_decomposition(spark):
    ids, v, _ = embeddings()
    x = (np.floor(64 * v) + 1_000_000).astype(np.int64)
    n, sums = len(x), x.sum(axis=0)
    mid = (n * x - sums) / n
    cov = mid.T @ mid / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    got = op11_embedding_whitening(spark, SF).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 32 * n and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    deviation = {i: int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))) for i, row in zip(ids, x, strict=True)}
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == deviation
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    plain = mid @ axes[:, :32] / np.sqrt(values[:32])
    assert np.abs(wide * np.sign((wide * plain).sum(axis=0)) - plain).max() < 1e-8
    shares = got.drop_duplicates("component").set_index("component").explained.sort_index()
    assert np.allclose(shares, values[:32] / np.trace(cov), rtol=1e-12)


@pytest.mark.parametrize("d, rank", [(1, 1), (5, 5), (12, 7), (33, 33)])
def test_factor_and_rotations(d, rank):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-4, 4, rank)
    v = a @ a.T
    factor, pivots = whitening.pivoted_cholesky(v)
    assert factor.shape[1] <= rank and np.allclose(factor @ factor.T, v, atol=1e-12 * np.trace(v))
    assert np.allclose(np.triu(factor[pivots], 1), 0)
    values, axes = whitening.one_sided_jacobi(factor)
    assert (np.diff(values) <= 0).all() and np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-9)
    assert np.allclose(axes * values @ axes.T, v, atol=1e-12 * np.trace(v))


def test_small_eigenvalues_keep_their_precision():
    """A graded matrix: the smallest eigenvalue is right to many digits, relative to itself."""
    scale = np.array([1.0, 1e-5, 1e-10])
    v = np.array([[1.0, 0.5, 0.5], [0.5, 1.0, 0.5], [0.5, 0.5, 1.0]]) * np.outer(scale, scale)
    values, _ = whitening.one_sided_jacobi(np.linalg.cholesky(v))
    assert abs(np.prod(values) / (0.5 * np.prod(scale) ** 2) - 1) < 1e-12


def test_whitening_of_odd_rows(spark):
    good = [(1, [0.0, 0.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0, 0.0], None), (2, [1.0, 0.0, 0.0, 0.0], None), (None, [0.0, 2.0, 0.0, 0.0], 1)]
    out = whitening.whiten(odd_vectors(spark, good)).collect()
    assert Counter((r.id, r.component) for r in out) == {(1, 1): 1, (1, 2): 1, (2, 1): 2, (2, 2): 2, (None, 1): 1, (None, 2): 1}  # rank 2
    assert {r.n for r in out} == {4} and max(r.identity_error for r in out) < 1e-12
    same = [(i, [0.5, 0.5, 0.5, 0.5], 1) for i in range(3)]
    for rows in (same, same[:1]):
        assert whitening.whiten(odd_vectors(spark, rows)).collect() == []
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == [] and whitening.whiten(spark.createDataFrame([(1, None, 1, "", "", 0)], SCHEMA)).collect() == []


def test_whitening_of_huge_components(spark):
    good = [(1, [1e300, 0.0, 1.0, 0.0], 1), (2, [-1e300, 0.0, 2.0, 0.0], 1), (3, [2.0**50, 5.0, 0.0, 0.0], 1)]
    out = whitening.whiten(odd_vectors(spark, good)).collect()
    assert {r.id for r in out} == {1, 2, 3} and {r.deviation for r in out} == {None}
    x = [[2**63 - 1 + 10**6, 10**6], [-(2**63) + 10**6, 10**6]]
    assert [[int(v) for v in r] for r in vectors.whole(np.array([[1e300, 0.0], [-1e300, 0.0]]), 64, 10**6)] == x


def test_sums_over_tasks_are_exact(spark):
    numbers = [2**62, 2**62, -5, 2**63 - 1, -(2**63), 7, 2**40]
    rows = [(k % 2, 100 + k, vectors.halves([v, -v])) for k, v in enumerate(numbers)]
    frame = spark.createDataFrame(rows, "at int, part int, sums array<long>").repartition(3)
    got = {r.at: vectors.joined(r.sums) for r in vectors.array_sums(frame, ["at"]).collect()}
    assert got == {k: [sum(numbers[k::2]), -sum(numbers[k::2])] for k in (0, 1)}


# --- vector codes


def plain_codes(rows, rounds=4):
    """The contract row by row: ids, integer vectors and labels of kept rows."""
    ids, x, labels = rows
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    parts = np.array_split(np.arange(x.shape[1]), 4)
    books = [[[int(c) for c in x[i][p]] for i in order[:256]] for p in parts]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in zip(parts, books, strict=True):
            owned = {}
            for row in x:
                part = [int(c) for c in row[p]]
                owned.setdefault(nearest(book, part)[1], []).append(part)
            for k, group in owned.items():
                book[k] = [sum(c) // len(group) for c in zip(*group, strict=True)]
    found = [[nearest(book, [int(c) for c in row[p]]) for p, book in zip(parts, books, strict=True)] for row in x]
    error = [sum(d for d, _ in f) for f in found]
    label_error = Counter()
    for label, e in zip(labels, error, strict=True):
        label_error[label] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return {(i, "".join(f"{k:02x}" for _, k in f), e, label_error[label], digest) for i, f, e, label in zip(ids, found, error, labels, strict=True)}


def test_codes_equal_the_plain_rounds(spark):
    ids, v, labels = embeddings()
    want = plain_codes((ids, np.floor(1024 * v).astype(int), labels))
    assert {tuple(r) for r in op12_vector_codes(spark, SF).collect()} == want


def test_codes_of_odd_rows(spark):
    good = [(5, [0.1, 0.2, 0.3, 0.4], None), (3, [0.1, 0.2, 0.3, 0.5], None), (4, [-0.1, 0.2, 0.3, 0.4], 7), (4, [-0.1, 0.2, 0.3, 0.4], 7)]
    out = vector_codes.encode(odd_vectors(spark, good)).collect()
    want = plain_codes(([i for i, _, _ in good], np.array([np.floor(1024 * np.array(v)) for _, v, _ in good]).astype(int), [x for _, _, x in good]))
    assert {(r.id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out} == want and len(out) == 4
    assert vector_codes.encode(spark.createDataFrame([], SCHEMA)).collect() == []
    with_null = vector_codes.encode(odd_vectors(spark, [(None, [9.0, 9.0, 9.0, 9.0], 1), *good])).collect()
    assert [r.code for r in with_null if r.id is None] == ["04040404"]  # its entries come last
    uneven = vector_codes.encode(spark.createDataFrame([(i, [float(i), 1.0, 2.0], 1, "", "", 0) for i in range(3)], SCHEMA)).collect()
    assert {(r.id, r.code, r.error) for r in uneven} == {(0, "00000000", 0), (1, "01000000", 0), (2, "02000000", 0)}


def test_codes_of_huge_components(spark):
    good = [(1, [1e300, 1.0, 0.0, 0.0], 1), (2, [-1e300, 2.0, 0.0, 0.0], 1), (3, [2.0**60, 5.0, 0.0, 0.0], 2), (4, [0.0, 5.0, 0.0, 0.0], 2)]
    out = {r.id: r for r in vector_codes.encode(odd_vectors(spark, good)).collect()}
    assert {i: r.error for i, r in out.items()} == {1: 0, 2: 0, 3: 0, 4: 0} and out[4].code == "03020000"


@pytest.mark.parametrize("case", ["spread", "clustered", "equal", "grid", "wide"])
def test_tree_search_equals_brute_force(case):
    rng = np.random.default_rng(3)
    entries = {
        "spread": lambda: rng.integers(-600, 600, (256, 16)),
        "clustered": lambda: rng.integers(-4000, 4000, (16, 16)).repeat(16, axis=0) + rng.integers(-9, 9, (256, 16)),
        "equal": lambda: np.full((256, 3), 5),
        "grid": lambda: rng.integers(0, 3, (256, 4)),
        "wide": lambda: rng.integers(-(2**62), 2**62, (60, 2)),
    }[case]()
    queries = np.concatenate([entries[::7], entries[rng.integers(0, len(entries), 400)] + rng.integers(-9, 9, (400, entries.shape[1]))])
    found = vector_codes.Search(entries, queries).run(vector_codes.build(entries))
    square = ((queries.astype(object)[:, None] - entries.astype(object)) ** 2).sum(axis=2)
    assert [int(x) for x in found.best] == [min(r) for r in square.tolist()]
    assert found.code.tolist() == [r.index(min(r)) for r in square.tolist()]  # ties: the lower index
    if case == "clustered":
        assert found.seen < 0.5 * square.size  # whole subtrees are left out


# --- licence scans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_scan(text):
    """Places of all phrases word by word, without an automaton."""
    words = WORD.findall(ascii_lower(text or ""))
    places = [(i, p) for p in {**license_scan.NOTICES, **license_scan.BASE} for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = [(i, license_scan.BASE[p]) for i, p in places if p in license_scan.BASE]
    named = {license_scan.NOTICES.get(p) or license_scan.BASE[p] for _, p in places}
    labels = {x for _, x in base} | named | {license_scan.family(x) for x in named}
    at = [i for i, _ in base]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))


def test_scan_equals_a_plain_search(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op13_license_scan(spark, SF).collect()
    assert {r.doc_id: tuple(r[1:7]) for r in out} == {i: plain_scan(t) for i, t in texts.items()}
    assert any(r.n_base for r in out) and all((r.score > 0) == (r.labels != "") for r in out)


@pytest.mark.parametrize(
    "text, n_base, base, labels, score",
    [
        (None, 0, "", "", 0.0),
        ("", 0, "", "", 0.0),
        ("Released under the MIT-License.", 1, "mit", "mit", 0.9),
        ("mit\n\n* license mit license", 2, "mit", "mit", 0.9),
        ("summit license, MIT licenses, mitlicense", 0, "", "", 0.0),
        ("émit license", 0, "", "", 0.0),
        ("CC BY-NC 4.0", 1, "cc-by", "cc-by,cc-by-nc,cc-by-nc-4.0", 0.1),
        ("CC BY 4.0 and the Apache License", 2, "apache,cc-by", "apache,cc-by,cc-by-4.0", 0.9),
        ("GNU General Public License, version 3", 1, "gpl", "gpl,gpl-3.0", 0.4),
        ("GNU Lesser General Public License", 0, "", "lgpl", 0.6),
        ("// SPDX-License-Identifier: MIT OR GPL-2.0-only */", 0, "", "gpl,gpl-2.0-only,mit", 0.9),
        ("SPDX-License-Identifier: MIT AND GPL-2.0-only\nmore", 0, "", "gpl,gpl-2.0-only,mit", 0.4),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", 0, "", "gpl,gpl-2.0-only", 0.6),
        ("SPDX-License-Identifier: (MIT OR CC0-1.0) AND Foo-1.0", 0, "", "cc0,cc0-1.0,mit,unknown", 0.0),
        ("SPDX-License-Identifier is a tag", 0, "", "", 0.0),
        ("SPDX-License-Identifier: ( AND", 0, "", "", 0.0),
        ("License-Expression: Apache-2.0\n\nApache License", 1, "apache", "apache,apache-2.0", 0.9),
        ("x " * 100_000 + "cc by", 1, "cc-by", "cc-by", 0.9),
    ],
)
def test_scans_of_literal_texts(text, n_base, base, labels, score):
    n, places, found, value, _ = license_scan.scan((text or "").encode())
    assert (len(places), ",".join(sorted({x for _, x in places})), ",".join(sorted(found)), value) == (n_base, base, labels, score)
    assert n == len(WORD.findall(ascii_lower(text or "")))


@pytest.mark.parametrize(
    "line, form",
    [
        ("mit", "mit"),
        ("mit or isc and zlib", "(mit or (isc and zlib))"),
        ("(mit or isc) and zlib", "((mit or isc) and zlib)"),
        ("mit and isc and zlib or bsd", "(((mit and isc) and zlib) or bsd)"),
        ("gpl-2.0 with e-1 or mit", "((gpl-2.0 with e-1) or mit)"),
        ("mit and (isc or (zlib and bsd))", "(mit and (isc or (zlib and bsd)))"),
        ("mit or", "mit"),
        ("mit or (isc and", "mit"),
        ("mit, see file", "mit"),
        ("mit license", "mit"),
        ("mit) or isc", "mit"),
        ("(mit", ""),
        ("or mit", ""),
        ("mit with (isc)", "mit"),
        ("(mit) with e-1", "mit"),
        ("gpl with a with b", "(gpl with a)"),
        ("(" * 5000 + "mit" + ")" * 5000, "mit"),
    ],
)
def test_expressions(line, form):
    found = license_scan.tokens(line)
    assert (license_scan.evaluate(found)[1] if found else "") == form


def test_expression_values_equal_a_recursive_evaluation():
    """Random trees are written out with all brackets; the parser finds their values again."""
    rng = np.random.default_rng(5)
    names = ["mit", "gpl-2.0-only", "lgpl-2.1", "cc-by-nc-4.0", "cc0-1.0", "foo"]

    def tree(depth):
        if not depth or rng.random() < 0.2:
            name = names[rng.integers(len(names))]
            return name, license_scan.grade(name)
        (a, x), (b, y), operator = tree(depth - 1), tree(depth - 1), ["and", "or"][rng.integers(2)]
        return f"({a} {operator} {b})", (min if operator == "and" else max)(x, y)

    for _ in range(200):
        text, value = tree(5)
        got, form, _ = license_scan.evaluate(license_scan.tokens(text))
        assert got == value and form == text


def test_scan_of_odd_rows(spark):
    rows = [(None, "mit license", "x", 1), (1, None, "x", 1), (1, "MIT License", None, 1), (1, "MIT License", None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, labels string, score int")
    got = sorted((r.id or 0, r.n_words, r.base_labels, r.score) for r in license_scan.scanned(frame).collect())
    assert got == [(0, 2, "mit", 0.9), (1, 0, "", 0.0), (1, 2, "mit", 0.9), (1, 2, "mit", 0.9)]
    assert license_scan.scanned(frame.limit(0)).collect() == []
