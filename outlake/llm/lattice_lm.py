"""Language-model scores from a subword lattice: the probability of a text over all its segmentations.

The vocabulary is an existing tokenizer's; its pieces' unigram scores are log-probabilities of their counts in the
training documents (segmented by that tokenizer, ``PIECE_PRIOR`` added to each piece).  The tokenizer's own scores
only rank merges and are no probabilities, so they serve for the counting alone.  A word is its metaspace marker and
its characters; a forward recursion in log space sums over all ways to cut it into pieces, characters without a piece
going through their bytes.  A text's probability is the product over its words and one end token.

1. Documents fall into chunks of about ``CHUNK_BYTES`` by a hash; each chunk gives its distinct words with their
   training counts, so a word that is everywhere is one row per chunk.
2. Counts are summed; each distinct word's lattice is evaluated once.
3. Each chunk's words come back with counts and lattice scores and meet the chunk's documents.

Defined results: null and empty texts have the end token alone; a document with a null id counts as held out;
repeated rows are learned from and scored once for each row; with no training documents all counts are 0; texts and
words are scored whole, whatever their length; empty tables give empty results; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlake.llm.common import save

CHUNK_BYTES = 16 << 20
PIECE_PRIOR = 0.1
FOLDS = 10
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _chunk_words(group: pa.Table) -> pa.Table:
    from collections import Counter

    train: Counter[bytes] = Counter()
    words: set[bytes] = set()
    for text, held_out in zip(group.column("text").cast(pa.binary()).to_pylist(), group.column("held_out").to_pylist(), strict=True):
        found = (text or b"").lower().split()
        if held_out:
            words.update(found)
        else:
            train.update(found)
            train[b""] += 1  # the end token
    words.update(train)
    listed = list(words)
    return pa.table(
        {
            "chunk": pa.array([group.column("chunk")[0].as_py()] * len(listed), pa.int64()),
            "word": pa.array(listed, pa.binary()),
            "n": pa.array([train[w] for w in listed], pa.int64()),
        }
    )


def _piece_counts(model_file: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            words = [w.decode("utf8", "replace") for w in batch.column("word").to_pylist()]
            for ids, n in zip(sp.encode(words, num_threads=1), batch.column("n").to_pylist(), strict=True):
                for i in ids:
                    total[i] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["piece", "n"])

    return run


class Lattice:
    """Marginal log-probabilities of words under unigram pieces."""

    def __init__(self, model_file: str, counts: dict[int, int], documents: int):
        from outlake.llm.sentencepiece_model import BYTE, MARK, NORMAL, USER_DEFINED, Model

        pieces = Model.read(model_file).pieces
        usable = [i for i, (_, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, BYTE)]
        total = sum(counts.get(i, 0) + PIECE_PRIOR for i in usable) + documents + PIECE_PRIOR
        score = {i: math.log((counts.get(i, 0) + PIECE_PRIOR) / total) for i in usable}
        self.mark = MARK
        self.pieces = {pieces[i][0]: score[i] for i in usable if pieces[i][2] != BYTE}
        self.bytes = {int(pieces[i][0][3:5], 16): score[i] for i in usable if pieces[i][2] == BYTE}
        self.longest = max(map(len, self.pieces))
        self.end = math.log((documents + PIECE_PRIOR) / total)

    def log10(self, word: str) -> float:
        text, pieces, longest = self.mark + word, self.pieces, self.longest
        n = len(text)
        ways: list[list[float]] = [[] for _ in range(n + 1)]
        ways[0].append(0.0)
        exp, log = math.exp, math.log
        for i in range(n):
            at = ways[i]
            if len(at) == 1:
                here = at[0]
            else:
                most = max(at)
                here = most + log(sum([exp(x - most) for x in at]))
            for j in range(i + 1, min(n, i + longest) + 1):
                p = pieces.get(text[i:j])
                if p is not None:
                    ways[j].append(here + p)
            if text[i] not in pieces:
                ways[i + 1].append(here + sum(self.bytes.get(b, -100.0) for b in text[i].encode("utf8", "replace")))
            ways[i] = []
        most = max(ways[n])
        return (most + log(sum([exp(x - most) for x in ways[n]]))) / log(10)


def _lattices(model_file: str, counts: dict[int, int], documents: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_file, counts, documents)
        for batch in batches:
            scores = [lattice.log10(w.decode("utf8", "replace")) if w else lattice.end / math.log(10) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(scores, pa.float64())], ["word", "n", "lattice"])

    return run


def _score(tokens: int, distinct: int, documents: int, end: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def base(c):
        import numpy as np

        return np.log10((c + 0.1) / (tokens + 0.1 * (distinct + 1)))

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        import numpy as np

        place = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        count = words.column("n").to_numpy().astype(np.float64)
        known, each, lattice = count > 0, base(count), words.column("lattice").to_numpy()
        last = float(base(np.float64(documents)))
        n_tokens, n_known, base_score, score = [], [], [], []
        for text in docs.column("text").cast(pa.binary()).to_pylist():
            at = np.array([place[w] for w in (text or b"").lower().split()], np.int64)
            n_tokens.append(len(at) + 1)
            n_known.append(int(known[at].sum()) + (documents > 0))
            base_score.append(float(each[at].sum()) + last)
            score.append(float(lattice[at].sum()) + end)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([tokens] * len(n_tokens), pa.int64()),
                "base_score": pa.array(base_score, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    return run


def lattice_scores(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True)))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / chunk_bytes))
    texts = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long"))
    local = save(texts.groupBy("chunk").applyInArrow(_chunk_words, "chunk long, word binary, n long"))
    counted = save(local.groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.where("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.octet_length("word") == 0, F.col("n"))).alias("docs")).first()
    tokens, distinct, documents = total.n or 0, total.v, total.docs or 0
    # at most one row per piece of the vocabulary comes to the driver
    pieces = counted.where("n > 0 and octet_length(word) > 0").mapInArrow(_piece_counts(model_file), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = {r.piece: r.n for r in pieces.collect()}
    known = save(counted.mapInArrow(_lattices(model_file, counts, documents), "word binary, n long, lattice double"))
    end = Lattice(model_file, counts, documents).end / math.log(10)
    back = local.select("chunk", "word").join(known, "word")
    return (
        texts.groupBy("chunk")
        .cogroup(back.groupBy("chunk"))
        .applyInArrow(_score(tokens, distinct, documents, end), _SCORED)
    )
