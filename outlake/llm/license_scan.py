"""Licence scans: one Aho-Corasick pass finds identifier tags and notice phrases; expressions are evaluated.

Texts become their words (A-Z lower-cased; everything else in ASCII but digits separates words), joined by one blank, so
that the automaton finds whole words that stand consecutively, whatever stands between them.  What follows an identifier
tag and a colon is read from the text itself, to the end of its line, as a licence expression: a shunting-yard parser
takes its longest well-formed beginning (``with`` binds closer than ``and``, ``and`` closer than ``or``) and evaluates it.

An expression's value is how free the use is that it grants, from 0 to 1 (``GRADES``): ``and`` is the smaller, ``or`` the
larger value, and ``with`` an exception lifts strong copyleft to weak.  A text's score is the ``and`` of all its
expressions and notices, and 0 without any; a notice inside a longer one (``cc by`` in ``cc by nc``) has no say of its own.

Labels: those of all phrases found, the identifiers in expressions, and the families of both.

Defined results: null and empty texts have no words and no labels; texts of any length are scanned whole; a tag without a
colon or a well-formed expression counts for nothing; identifiers of unknown licences have the label ``unknown`` and the
value 0; parentheses nest to any depth; null ids are carried along, ties and repeated rows are scanned once for each
row; empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that count as base places, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notices, and the identifier that each names.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license v2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license v3": "gpl-3.0",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "apache license version 2 0": "apache-2.0",
    "apache license 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "bsd license": "bsd",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license": "bsl-1.0",
    "zlib license": "zlib",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "mozilla public license v 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "eclipse public license v 2 0": "epl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "public domain dedication": "cc0",
    "cc0 1 0 universal": "cc0-1.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa": "cc-by-sa",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution 4 0": "cc-by-4.0",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
}
# Words of identifier tags.
TAGS = ("spdx license identifier", "license expression", "packagelicenseconcluded", "packagelicensedeclared", "licenseconcluded")
# Families, by how identifiers begin (the longest beginning counts), and how free a use they grant.
GRADES = {
    "cc0": 1.0,
    "unlicense": 1.0,
    "0bsd": 1.0,
    "mit": 0.9,
    "isc": 0.9,
    "zlib": 0.9,
    "bsd": 0.9,
    "bsl": 0.9,
    "apache": 0.9,
    "cc-by": 0.9,
    "lgpl": 0.6,
    "mpl": 0.6,
    "epl": 0.6,
    "cc-by-sa": 0.4,
    "gpl": 0.4,
    "agpl": 0.3,
    "cc-by-nd": 0.1,
    "cc-by-nc": 0.1,
    "cc-by-nc-sa": 0.1,
    "cc-by-nc-nd": 0.1,
}
LIFTED = 0.6  # copyleft with an exception
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: A-Z lower-cased, digits, and every byte of a character outside ASCII; all else is a blank.  Bytes keep their places.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_VALUE = re.compile(rb"""[ \t"']*[:=][ \t"']*([^\r\n]*)""")
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9.+:-]+)")
_SCAN = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"


def family(identifier: str) -> str | None:
    """The longest listed family that the identifier begins with."""
    parts = identifier.rstrip("+").split("-")
    for k in range(len(parts), 0, -1):
        if "-".join(parts[:k]) in GRADES:
            return "-".join(parts[:k])
    return None


def grade(identifier: str) -> float:
    return GRADES.get(family(identifier) or "", 0.0)


def tokens(line: str) -> list[str]:
    """The longest well-formed beginning of a line as an expression; empty if there is none."""
    found, at, open_ones, whole, operand, exception = [], 0, 0, 0, False, False
    while m := _TOKEN.match(line, at):
        token, at = m[1], m.end()
        if not operand:
            if token == "(" and not exception:
                open_ones += 1
            elif token in ("(", ")") or token in PRECEDENCE:
                break
            else:
                operand = True
        elif token == ")" and open_ones:
            open_ones -= 1
            exception = False
        elif token in PRECEDENCE and not (token == "with" and (exception or found[-1] == ")")):
            operand, exception = False, token == "with"
        else:
            break
        found.append(token)
        if operand and not open_ones:
            whole = len(found)
    return found[:whole]


def evaluate(expression: list[str]) -> tuple[float, str, list[str]]:
    """A well-formed expression's value, its fully bracketed form and its identifiers, by two stacks."""
    values: list[tuple[float, str]] = []
    operators: list[str] = []
    identifiers: list[str] = []

    def reduce() -> None:
        operator, (b, right), (a, left) = operators.pop(), values.pop(), values.pop()
        value = max(a, LIFTED) if operator == "with" and 0 < a < LIFTED and _copyleft(left) else a
        value = {"and": min(a, b), "or": max(a, b), "with": value}[operator]
        values.append((value, f"({left} {operator} {right})"))

    for token in expression:
        if token == "(":
            operators.append(token)
        elif token == ")":
            while operators[-1] != "(":
                reduce()
            operators.pop()
        elif token in PRECEDENCE:
            while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[token]:
                reduce()
            operators.append(token)
        else:
            if not operators or operators[-1] != "with":
                identifiers.append(token)
            values.append((grade(token), token))
    while operators:
        reduce()
    value, text = values[0]
    return value, text, identifiers


def _copyleft(identifier: str) -> bool:
    return family(identifier) in ("gpl", "agpl", "lgpl")


@lru_cache(maxsize=1)
def automaton():
    """Phrases between blanks, with their number of words and what they say: a base label, an identifier, a tag."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        out.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, BASE.get(phrase), NOTICES.get(phrase) or BASE.get(phrase)))
    out.make_automaton()
    return out


def _named(identifier: str) -> set[str]:
    return {identifier, family(identifier)} if family(identifier) else {"unknown"}


def scan(text: bytes) -> tuple[int, list[tuple[int, str]], set[str], float, list[str]]:
    """Number of words; base places (word, label); all labels; score; expressions in their bracketed form."""
    folded = text.translate(_FOLD)
    words = folded.split()
    joined = f" {b' '.join(words).decode()} "
    places, notices, tags = [], [], []
    at = before = 0
    for end, (length, count, base, identifier) in automaton().iter(joined):
        before, at = before + joined.count(" ", at, end), max(at, end)
        first = before - count  # the blank at ``end`` closes the phrase's last word
        if base:
            places.append((first, base))
        if identifier:
            notices.append((first, first + count, identifier))
        else:
            tags.append(first + count - 1)
    labels, values, forms = set(), [], []
    labels.update(label for _, label in places)
    longest = -1
    for first, last, identifier in sorted(notices, key=lambda x: (x[0], -x[1])):
        labels |= _named(identifier)
        if last > longest:  # not inside one that began before
            values.append(grade(identifier))
            longest = last
    if tags:
        for value, form, identifiers in map(evaluate, filter(None, map(tokens, _values(text, folded, tags)))):
            values.append(value)
            forms.append(form)
            for identifier in identifiers:
                labels |= _named(identifier)
    return len(words), places, labels, min(values, default=0.0), forms


def _values(text: bytes, folded: bytes, tags: list[int]) -> Iterator[str]:
    """What follows each tag (the number of its last word) and a colon, to the end of the line, lower-cased."""
    wanted, last = set(tags), max(tags)
    for number, word in enumerate(_WORD.finditer(folded)):
        if number in wanted and (m := _VALUE.match(text, word.end())):
            yield m[1].lower().decode()
        if number == last:
            return


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions``."""

    def joined(labels) -> str:
        return ",".join(sorted(set(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n, places, labels, score, forms = scan(text.as_buffer().to_pybytes() if text.is_valid else b"")
                at = [i for i, _ in places]
                rows.append((n, len(at), min(at, default=None), max(at, default=None), joined(x for _, x in places), joined(labels), score, forms))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], _names)

    _names = [c.strip().split(" ")[0] for c in _SCAN.split(",")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _SCAN)
