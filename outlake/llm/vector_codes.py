"""Vector codes: product quantisation in integers, with a GNAT over each codebook's entries.

Components become integers floor(1024 x), vectors four parts; each part has a codebook of up to 256 entries, which begins
with the parts of the smallest ids and is refined in rounds: all parts are assigned to their nearest entry, entries
become the componentwise floor of their parts' mean.  Assignment, a search of the nearest entry, goes through a geometric
near-neighbour access tree: a node holds a few split points and, for each split point and each child, the range of the
distances between them.  A child is left out if a query's distance to some split point, less or more the best distance
so far, lies strictly outside that range; distances are rounded down or up, to the safe side, and what is found is
compared in exact integer squares, ties going to the lower index.  Queries are searched in batches; each first goes
down to its nearest split points, so that its best distance is small when it is searched again in full.

Tasks return sums for each part and entry; only those (added up over tasks: four rows) and the codebooks reach the driver.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped, as are those of another
length than the commonest one (ties: the longest); where a length isn't a multiple of four the first parts are one
longer, and parts without components have distance 0; components of any size are taken (floors beyond a long are its
limits); an error, or sum of errors, beyond a long is null; fewer than 256 vectors give fewer entries; rows with a null id are coded, and
come last when codebooks begin; rows of a repeated id are taken in the order of their vectors; null labels are one label;
empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlake.llm.common import save
from outlake.llm.vectors import array_sums, column_sums, halves, joined, matrix, usable, whole

FACTOR = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
DEGREE = 8
SLACK = 1e-12  # far more than what square roots and their sums lose, as a share of the distance
_OUT = "id long, label {label}, code string, error long, label_error long, codebooks_sha256 string"


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two integer arrays (doubles that are whole, or Python integers)."""
    peak = max([int(np.abs(x).max()) for x in (a, b) if x.size], default=0)
    if a.dtype != object and b.dtype != object and 4 * max(a.shape[1], 1) * peak**2 < 2**52:
        x, y = a.astype(float), b.astype(float)
        return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    x, y = a.astype(object), b.astype(object)
    out = np.empty((len(x), len(y)), object)
    for j, row in enumerate(y):
        out[:, j] = ((x - row) ** 2).sum(axis=1) if x.shape[1] else 0
    return out


def _down(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(float)) * (1 - SLACK)


def _up(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(float)) * (1 + SLACK)


@dataclass
class Node:
    """Split points (indices of entries, rising), what hangs below each, and the ranges of distances: row i, column j
    for split point i and child j, the split point of which counts as its own."""

    splits: np.ndarray
    children: list[Node | None] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def build(entries: np.ndarray, members: np.ndarray | None = None) -> Node:
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= 2 * DEGREE:
        return Node(members)
    # split points: each the farthest from those before it
    apart = squares(entries[members], entries[members])
    chosen, nearest = [0], apart[:, 0].copy()
    while len(chosen) < DEGREE:
        nearest[chosen] = -1
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, apart[:, chosen[-1]])
    chosen.sort()
    rest = np.setdiff1d(np.arange(len(members)), chosen)
    owner = np.argmin(apart[np.ix_(rest, chosen)], axis=1)
    node = Node(members[chosen], low=np.empty((DEGREE, DEGREE)), high=np.empty((DEGREE, DEGREE)))
    for j in range(DEGREE):
        below = rest[owner == j]
        node.children.append(build(entries, members[below]) if len(below) else None)
        ranges = apart[np.ix_(chosen, [chosen[j], *below])]
        node.low[:, j], node.high[:, j] = _down(ranges.min(axis=1)), _up(ranges.max(axis=1))
    return node


class Search:
    """The nearest entry of each query: its index, and the squared distance."""

    def __init__(self, entries: np.ndarray, queries: np.ndarray):
        self.entries, self.queries = entries, queries
        self.code = np.full(len(queries), len(entries))
        self.best = np.full(len(queries), np.inf, object if object in (entries.dtype, queries.dtype) else float)
        self.seen = 0  # distances computed

    def run(self, tree: Node) -> Search:
        everyone = np.arange(len(self.queries))
        self._descend(tree, everyone)
        self._walk(tree, everyone)
        return self

    def _look(self, node: Node, at: np.ndarray) -> np.ndarray:
        square = squares(self.queries[at], self.entries[node.splits])
        self.seen += square.size
        first = np.argmin(square, axis=1)
        found, index = square[np.arange(len(at)), first], node.splits[first]
        better = (found < self.best[at]) | (found == self.best[at]) & (index < self.code[at])
        self.best[at[better]], self.code[at[better]] = found[better], index[better]
        return square

    def _descend(self, node: Node, at: np.ndarray) -> None:
        near = np.argmin(self._look(node, at), axis=1)
        for j, child in enumerate(node.children):
            if child is not None and (near == j).any():
                self._descend(child, at[near == j])

    def _walk(self, node: Node, at: np.ndarray) -> None:
        square = self._look(node, at)
        if not node.children:
            return
        low, high = _down(square), _up(square)
        for j, child in enumerate(node.children):
            if child is None:
                continue
            reach = _up(self.best[at])[:, None]
            out = (low - reach > node.high[:, j]) | (high + reach < node.low[:, j])
            alive = at[~out.any(axis=1)]
            if len(alive):
                self._walk(child, alive)


def cuts(size: int) -> list[slice]:
    ends = np.cumsum([0] + [len(x) for x in np.array_split(np.arange(size), PARTS)])
    return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _searches(v: np.ndarray, books: list[np.ndarray], trees: list[Node]) -> list[Search]:
    x = whole(v, FACTOR)
    return [Search(book, x[:, cut]).run(tree) for cut, book, tree in zip(cuts(v.shape[1]), books, trees, strict=True)]


def _round(size: int, books: list[np.ndarray]) -> Callable:
    """For each task and position: the exact sums of the parts of every entry, and how many parts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trees = [build(b) for b in books]
        total = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
        for batch in batches:
            v = matrix(batch, size)
            for held, cut, search in zip(total, cuts(size), _searches(v, books, trees), strict=True):
                x = whole(v, FACTOR)[:, cut]
                order = np.argsort(search.code, kind="stable")
                found, starts = np.unique(search.code[order], return_index=True)
                for e, a, b in zip(found, starts, [*starts[1:], len(order)], strict=True):
                    held[e] += np.array([*column_sums(x[order[a:b]]), int(b - a)], object)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(PARTS), pa.int32()),
                pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32()),
                pa.array([halves(held.ravel().tolist()) for held in total], pa.list_(pa.int64())),
            ],
            ["position", "part", "sums"],
        )

    return run


def fitted(rows: DataFrame, size: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    x = whole(np.array([r.v for r in first], float), FACTOR)
    books = [x[:, cut] for cut in cuts(size)]
    for _ in range(rounds):
        partial = rows.select("v").mapInArrow(_round(size, books), "position int, part int, sums array<long>")
        lists = [b.astype(object) for b in books]
        for r in array_sums(partial, ["position"]).collect():
            book = lists[r.position]
            for entry, (*sums, count) in zip(book, np.array(joined(r.sums), object).reshape(len(book), -1), strict=True):
                if count:
                    entry[:] = [s // count for s in sums]
        books = [b.astype(np.int64) if not b.size or max(map(abs, b.ravel())) < 2**62 else b for b in lists]
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """``id, label, code, error, label_error, codebooks_sha256``."""
    label = dict(vectors.dtypes)[label_col]
    rows, size, n = usable(vectors, id_col, vector_col, label_col)
    if not n:
        return vectors.sparkSession.createDataFrame([], _OUT.format(label=label))
    books = fitted(rows, size, rounds)
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build(b) for b in books]
        for batch in batches:
            found = _searches(matrix(batch, size), books, trees)
            code = np.stack([s.code for s in found], axis=1).astype(np.uint8)
            # sums of whole doubles are exact up to 2 ** 53
            parts = np.stack([s.best for s in found], axis=1)
            error = [int(e) for e in (parts if parts.dtype != object and (not parts.size or parts.max() < 2**50) else np.vectorize(int, otypes=[object])(parts)).sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array([e if e < 2**63 else None for e in error], pa.int64())],
                ["id", "label", "code", "error"],
            )

    kept = rows.withColumnRenamed(f"more_{label_col}", "label")
    coded = save(kept.select("id", "label", "v").mapInArrow(run, f"id long, label {label}, code string, error long"))
    # a table of one row per label: small ones are broadcast by their size, larger ones joined, hot labels split by AQE
    totals = save(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
