"""Encode and decode documents with a SentencePiece model (see ``sentencepiece_model``).

Defined results: null and empty texts have no ids; null ids are carried along; repeated rows are encoded once for each
row; texts are encoded whole, whatever their length; empty tables give empty results; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_codecs: dict = {}
BATCH_BYTES = 1 << 20
THREADS = "2"  # of the library in each task; Spark's tasks use the cores as well


def codec(path: str):
    import os

    from outlake.llm.sentencepiece_model import Codec

    os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _groups(sizes: list[int]) -> Iterator[slice]:
    at = 0
    while at < len(sizes):
        to, total = at + 1, sizes[at]
        while to < len(sizes) and total + sizes[to] <= BATCH_BYTES:
            total += sizes[to]
            to += 1
        yield slice(at, to)
        at = to


def _run(path: str, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib
        from array import array

        import sentencepiece

        own, theirs = codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for part in _groups([len(x) for x in texts]):
                some = texts[part]
                ids, same = own.encode_checked(some)
                parity = [array("I", y).tobytes() == x for x, y in zip(ids, theirs.encode(some, num_threads=1), strict=True)]
                columns = [
                    batch.column("doc_id")[part.start : part.stop],
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array(same, pa.bool_()),
                    pa.array(parity, pa.bool_()),
                ]
                names = ["doc_id", "n_ids", "ids_crc32", "round_trip", "parity"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, round_trip`` (decoding gives the text again), ``parity`` (the ids are those of the
    SentencePiece library) and ``ids`` (little-endian 32-bit numbers)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids binary" * with_ids
    return texts.mapInArrow(_run(model_file, with_ids), kind)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            texts = own.decode([x or b"" for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
