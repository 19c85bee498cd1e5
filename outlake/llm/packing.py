"""Bounded-space online best-fit packing of tokenised documents.

The texts are tokenised where they are read; only the pieces' lengths (not their tokens) go on, dealt out by a hash of
document and piece in partitions of Spark's advisory size and sorted there, so that a task that is run again packs the
same rows in the same order.  A piece goes to the open bin that it fills best, found in a bitset keyed by free space; a
fixed number of bins may be open, and when one more is needed the fullest closes.  Sequence numbers hold the
partition's number.

Defined results: null and empty texts give one piece with the end id alone; a document longer than a sequence, however
long, is tokenised whole and cut into whole sequences and a rest; null ids are carried along; repeated rows and ties
are packed once for each row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 4096
OPEN_BINS = 512
END_ID = 1
CACHE_WORDS = 400_000
GROUP_BYTES = 1 << 18
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"


#: The normaliser and the pattern of pre-tokens under which a text's ids are its words' ids.
NORMALISER = ["NFC", "Replace", "Lowercase"]
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


class WordEncoder:
    """Token ids of whole texts through a cache of blank-separated words, as little-endian 32-bit ids.

    Holds for tokenizers that lower-case, treat white space as a boundary that leaves no token, make one pre-token of a
    run of letters and another of the punctuation after it, and mark the last token of each pre-token (``by_words``,
    read from the file); so a text's ids are its words' ids one after another.  New words of letters are encoded
    together in one call and told apart by the marks: each has one mark at least, so equal numbers of words and marks
    mean one for each.  An ASCII word of letters and a full stop or comma is two pre-tokens.  Words of any other shape
    are encoded one by one.  Two generations of ``CACHE_WORDS`` words at most are kept; frequent words move on from the
    old one.  Texts of other tokenizers are encoded whole.
    """

    def __init__(self, tokenizer_file: str):
        import json

        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        with open(tokenizer_file, encoding="utf8") as f:
            self.by_words = self._separable(json.load(f))

    @staticmethod
    def _separable(spec: dict) -> bool:
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        added = spec.get("added_tokens") or []
        return (
            [x["type"] for x in steps] == NORMALISER
            and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": PRE_TOKENS}, "Removed", True)
            and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
            and (spec["model"]["type"], spec["model"]["end_of_word_suffix"]) == ("BPE", WORD_END)
            and all(x["content"].startswith("<|") and not (x["normalized"] or x["lstrip"] or x["rstrip"] or len(x["content"].split()) > 1) for x in added)
        )

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return self._one(texts)
        # added tokens are found before texts are lower-cased
        cut = [(x if b"<|" in x else x.lower()).split() for x in texts]
        found = [list(map(self.known.get, words)) for words in cut]
        new = {w for words, ids in zip(cut, found, strict=True) if None in ids for w, x in zip(words, ids, strict=True) if x is None}
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.old, self.known = self.known, {}
            self._learn(new)
        known = self.known
        return [b"".join([known[w] if x is None else x for w, x in zip(words, ids, strict=True)] if None in ids else ids) for words, ids in zip(cut, found, strict=True)]

    def _learn(self, words: set[bytes]) -> None:
        known, old = self.known, self.old
        letters, marked, foreign, other = [], [], [], []
        for w in words:
            if w in old:
                known[w] = old[w]
            elif w.isalpha():  # ASCII letters
                letters.append(w)
            elif w[-1:] in (b".", b",") and w[:-1].isalpha():
                marked.append(w)
            elif not w.isascii() and w.decode("utf8", "replace").lower().isalpha():
                foreign.append(w)
            else:
                other.append(w)
        stems = {w[:-1] for w in marked}.difference(letters)
        known.update((x, old[x]) for x in stems if x in old)
        self._together([*letters, *(x for x in stems if x not in known)])
        self._together(foreign)
        signs = dict(zip((b".", b","), self._one([b".", b","]), strict=True)) if marked else {}
        known.update((w, known[w[:-1]] + signs[w[-1:]]) for w in marked)
        known.update(zip(other, self._one(other), strict=True))

    def _one(self, words: list[bytes]) -> list[bytes]:
        import numpy as np

        texts = [w.decode("utf8", "replace") for w in words]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[bytes]) -> None:
        import numpy as np

        if not words:
            return
        joined = b" ".join(words).decode("utf8", "replace")
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(cuts) == len(words):
            data = ids.tobytes()
            self.known.update(zip(words, [data[a:b] for a, b in zip([0, *cuts], cuts)], strict=True))
        else:
            self.known.update(zip(words, self._one(words), strict=True))


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer_file: str) -> WordEncoder:
    """The worker's encoder: workers are used again, and so are the words that they know."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def _groups(texts: list[bytes]) -> Iterator[slice]:
    """Texts that are encoded in one go: about ``GROUP_BYTES``, one text at least."""
    at = total = 0
    for i, x in enumerate(texts):
        if i > at and total + len(x) > GROUP_BYTES:
            yield slice(at, i)
            at, total = i, 0
        total += len(x)
    if at < len(texts):
        yield slice(at, len(texts))


def _pieces(tokenizer_file: str, size: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import zlib

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        encode, end = encoder(tokenizer_file), end_id.to_bytes(4, "little")
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            out: list[list] = [[], [], [], [], []]
            for group in _groups(texts):
                for doc, ids in zip(docs[group], encode(texts[group]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class BestFit:
    """Open bins by free space; bit f of ``free`` is set while a bin with f free places is open."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free = self.open = self.made = 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        number = stack.pop()
        if not stack:
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the place in it."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.size, self.made
            self.made += 1
        left = space - length
        if left:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            self.bins.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.size - space


def _pack(size: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, BestFit(size, most)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + n for n, _ in placed], pa.int64()), pa.array([p for _, p in placed], pa.int64())],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    return run


def pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_pieces(tokenizer_file, size, end_id), _PIECES)


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    cut = pieces(docs, tokenizer_file, id_col, text_col, size, end_id)
    dealt = cut.hint("rebalance", "doc_id", "piece").sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(_pack(size, open_bins), _PACKED)
