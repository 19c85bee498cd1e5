"""SentencePiece models through the tokenizers library: parse, rebuild, encode, decode, verify.

The model file's protobuf is read field by field.  The rebuilt tokenizer has the model's normaliser (its compiled
character map, if it has one, blank handling and the metaspace marker), its vocabulary (unigram scores, or merges
ranked by the scores of the merged pieces) and byte fallback.

Texts are encoded by segments: no piece has a metaspace after another character, and no piece has a character that
the vocabulary lacks (such as a line break), so ids of a text are the ids of its segments one after another.  Both
facts are checked when the model is read; where they don't hold, whole texts are the segments.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHE_SEGMENTS = 300_000
WORDS_OF_ITEM = 512


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protobuf message: integers, 4- or 8-byte strings, or byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(wire) or varint()
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_blanks: bool = True
    unknown: int = 0

    @staticmethod
    def read(path: str) -> Model:
        out = Model()
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                out.pieces.append((one[1].decode("utf8"), struct.unpack("<f", one.get(2, bytes(4)))[0], one.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                out.kind, out.byte_fallback, out.unknown = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
            elif number == 3:
                spec = dict(_fields(value))
                out.charsmap, out.dummy_prefix, out.remove_extra_blanks = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return out

    def vocabulary(self) -> dict[str, int]:
        return {p: i for i, (p, _, _) in enumerate(self.pieces)}

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that join to a piece, best score first."""
        known = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for p in known:
            cuts = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
            found += [(-self.pieces[known[p]][1], known[a], known[b], a, b) for a, b in cuts]
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self, normalise: bool = True):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == BPE:
            model = models.BPE(self.vocabulary(), self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        if normalise:
            steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
            if self.remove_extra_blanks:
                steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
            steps += [normalizers.Prepend(MARK)] if self.dummy_prefix else []
            out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
            if self.separable():
                out.pre_tokenizer = pre_tokenizers.Split(Regex(self.segment_pattern()), "isolated")
        strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return out

    def separable(self) -> bool:
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))

    def segment_pattern(self) -> str:
        breaks = any("\n" in p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
        return f"{MARK}*[^{MARK}]+|{MARK}+" if breaks else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+"


class Codec:
    """Encodes and decodes batches; new segments are encoded together, on the library's threads."""

    def __init__(self, path: str):
        import numpy as np

        self.model = Model.read(path)
        self.segments = self.model.tokenizer(normalise=False)
        self.whole = self.model.tokenizer()
        self.apart = self.model.separable()
        self.find = re.compile(self.model.segment_pattern()).findall if self.apart else lambda x: [x] if x else []
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: set[str] = set()  # segments that decoding doesn't give again
        m = self.model
        # words can be looked up as they stand in the text
        self.by_words = self.apart and m.dummy_prefix and not m.charsmap and not m.remove_extra_blanks and self.find("a\nb") == ["a", "\n", "b"]
        if self.by_words:
            self.segments.pre_tokenizer = self.whole.pre_tokenizer
        self.begins = np.array([p.startswith(MARK) and kind == NORMAL for p, _, kind in m.pieces])

    def normalised(self, text: str) -> str:
        m = self.model
        if m.charsmap or m.remove_extra_blanks:
            return self.whole.normalizer.normalize_str(text)
        return MARK * (m.dummy_prefix and bool(text)) + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers."""
        return self.encode_checked(texts)[0]

    def encode_checked(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids, and whether decoding them gives the texts again.  Where segments are apart, so are their texts: new
        segments are decoded once, words by the item that encoded them."""
        cut = [self._cut(t) for t in texts]
        found = [list(map(self.known.get, x)) for x in cut]
        new = {s for x, ids in zip(cut, found, strict=True) if None in ids for s, i in zip(x, ids, strict=True) if i is None}
        if len(self.known) + len(new) > CACHE_SEGMENTS:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        plain, other = [], []
        for s in new:
            if s in old:
                known[s] = old[s]
            else:
                (plain if self.by_words and s and s[0] not in ("\n", "\0", MARK) else other).append(s)
        self._encode_new(plain, other)
        ids = [b"".join([known[s] if i is None else i for s, i in zip(x, at, strict=True)] if None in at else at) for x, at in zip(cut, found, strict=True)]
        if self.odd or not self.apart:
            return ids, [x == y for x, y in zip(self.decode(ids), texts, strict=True)]
        return ids, [True] * len(texts)

    def _plain(self, segment: str) -> str:
        """What decoding a segment should give: blanks for metaspaces, the first one away."""
        text = segment.replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def _encode_new(self, plain: list[str], other: list[str]) -> None:
        import numpy as np

        known, other = self.known, list(other)
        # a piece that begins with the metaspace begins a word, so many words can be one item of the batch
        items = [plain[i : i + WORDS_OF_ITEM] for i in range(0, len(plain), WORDS_OF_ITEM)]
        encoded = [e.ids for e in self.segments.encode_batch_fast([MARK + MARK.join(x) for x in items], add_special_tokens=False)]
        decoded = self.whole.decode_batch(encoded, skip_special_tokens=False)
        for words, item, text in zip(items, encoded, decoded, strict=True):
            ids = np.array(item, "<u4")
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(words) and text == " ".join(words):
                data, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
                known.update(zip(words, [data[a:b] for a, b in zip((4 * starts).tolist(), ends, strict=True)], strict=True))
            else:
                other += words
        asked = [s if not self.by_words or s[:1] in ("\n", MARK) else s[1:] if s[:1] == "\0" else MARK + s for s in other]
        alone = [e.ids for e in self.segments.encode_batch_fast(asked, add_special_tokens=False)]
        for s, ids, text in zip(other, alone, self.whole.decode_batch(alone, skip_special_tokens=False), strict=True):
            known[s] = np.array(ids, "<u4").tobytes()
            if text != (self._plain(s[1:] if self.by_words and s[:1] == "\0" else s) if not self.by_words or s[:1] in ("\0", MARK) else s):
                self.odd.add(s)

    def _cut(self, text: str) -> list[str]:
        """The text's keys in the cache: words between single blanks (a line's first word has the line break before
        it), or, where blanks or metaspaces make it harder, segments as the model sees them."""
        if self.by_words and text and "  " not in text and " \n" not in text and text[0] != " " and text[-1] != " " and MARK not in text and "\0" not in text:
            return text.replace("\n", " \n").split(" ")
        found = self.find(self.normalised(text))
        return [s if s[0] in ("\n", MARK) else "\0" + s for s in found] if self.by_words else found

    def decode(self, batch: list[bytes]) -> list[str]:
        """Texts of ids by the rebuilt decoder: metaspaces to blanks, byte pieces to characters, the first blank away."""
        import numpy as np

        return self.whole.decode_batch([np.frombuffer(x, "<u4").tolist() for x in batch], skip_special_tokens=False)
