"""License scans: an Aho-Corasick automaton finds phrases and tags, a shunting-yard parser reads expressions.

Phrases are matched on the text's words, so that punctuation and line breaks inside a
notice do not matter. Tags such as ``SPDX-License-Identifier:`` are matched on the raw
text, and what follows them on the line is parsed as an expression of licence names
with ``and``, ``or``, ``with`` and brackets (``with`` binds closest, then ``and``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Notice phrases that name a licence more exactly: phrase, label, confidence.
NOTICES = (
    ("licensed under the mit license", "mit", 0.95),
    ("released under the mit license", "mit", 0.95),
    ("permission is hereby granted free of charge", "mit", 0.8),
    ("licensed under the apache license version 2 0", "apache-2.0", 0.95),
    ("apache license version 2 0", "apache-2.0", 0.9),
    ("gnu general public license version 2", "gpl-2.0", 0.9),
    ("gnu general public license version 3", "gpl-3.0", 0.9),
    ("gnu lesser general public license", "lgpl", 0.9),
    ("gnu affero general public license", "agpl", 0.9),
    ("mozilla public license version 2 0", "mpl-2.0", 0.9),
    ("redistribution and use in source and binary forms", "bsd", 0.8),
    ("bsd 2 clause", "bsd-2-clause", 0.8),
    ("bsd 3 clause", "bsd-3-clause", 0.8),
    ("licensed under cc by 4 0", "cc-by-4.0", 0.95),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", 0.95),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", 0.95),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0", 0.95),
    ("all rights reserved", "proprietary", 0.4),
)
BASE_CONFIDENCE = 0.7
TAGS = ("spdx-license-identifier:", "license-expression:")
TAG_CONFIDENCE = 1.0

# Licences that allow reuse with attribution at most; an expression is judged against them.
PERMISSIVE = frozenset({"mit", "apache", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0"})

_LOWER = bytes(range(256)).lower()
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in _LOWER)
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Expression:
    """A parsed licence expression in postfix order, as the shunting-yard parser gives it: every operator follows its two sides.

    All readings walk the items once, with a stack of their own, so that expressions of any length and depth can be read.
    """

    items: tuple[str, ...]

    def names(self) -> set[str]:
        """Licences named; an exception after ``with`` stays with its licence."""
        stack: list[str] = []
        for item in self.items:
            if item == "with":
                exception, name = stack.pop(), stack.pop()
                stack.append(f"{name} with {exception}")
            elif item not in _BINDS:
                stack.append(item)
        return set(stack)

    def allowed(self, licences: frozenset[str] = PERMISSIVE) -> bool:
        """Whether the expression can be met by ``licences``: either side of an or, both of an and; an exception only widens."""
        stack: list[bool] = []
        for item in self.items:
            if item in _BINDS:
                right, left = stack.pop(), stack.pop()
                stack.append((left or right) if item == "or" else (left and (item == "with" or right)))
            else:
                stack.append(item in licences)
        return stack[0]

    def __str__(self) -> str:
        """All brackets written. Names stand in the same order in both notations, so an operator opens before its first and closes after its last name."""
        names = [item for item in self.items if item not in _BINDS]
        opened, closed, between = [0] * len(names), [0] * len(names), [""] * len(names)
        stack: list[tuple[int, int]] = []
        at = 0
        for item in self.items:
            if item in _BINDS:
                (middle, last), (first, _) = stack.pop(), stack.pop()
                opened[first] += 1
                closed[last] += 1
                between[middle] = f" {item} "
                stack.append((first, last))
            else:
                stack.append((at, at))
                at += 1
        return "".join(f"{b}{'(' * o}{name}{')' * c}" for b, o, name, c in zip(between, opened, names, closed))


def parse_expression(text: str, start: int = 0, end: int | None = None) -> Expression | None:
    """The longest licence expression at ``start`` of ``text``, lower-cased; None if there is none.

    Reading stops at ``end`` (by default the end of the line), or where a name cannot be
    followed. ``with`` stands between two names, as its exception belongs to one
    licence. An unfinished tail (an operator without a right side, an open bracket) is
    left off.
    """
    if end is None:
        end = len(text) if (at := text.find("\n", start)) < 0 else at
    output: list[str] = []
    operators: list[str] = []
    names = brackets = 0
    want_name, simple = True, False

    def reduce():
        output.append(operators.pop())

    at = start
    while found := _TOKEN.match(text, at, end):
        token = found[1].lower()
        if want_name:
            if token == "(" and operators[-1:] != ["with"]:
                operators.append(token)
                brackets += 1
            elif token in _BINDS or token in "()":
                break
            else:
                simple = operators[-1:] != ["with"]
                output.append(token.rstrip(".") or token)
                names += 1
                want_name = False
        elif token in _BINDS and (token != "with" or simple):
            while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[token]:
                reduce()
            operators.append(token)
            want_name = True
        elif token == ")" and brackets:
            while operators[-1] != "(":
                reduce()
            operators.pop()
            brackets -= 1
            simple = False
        else:
            break
        at = found.end()
    # An unfinished tail: open brackets, and the operator before them if no name follows it.
    while want_name and operators:
        want_name = operators.pop() == "("
    while operators:
        if operators[-1] == "(":
            operators.pop()
        else:
            reduce()
    return Expression(tuple(output)) if output else None


@lru_cache(maxsize=1)
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases = ahocorasick.Automaton()
    meaning: dict[str, list[tuple[str, float, bool]]] = {}
    for phrase, label in BASE_PHRASES.items():
        meaning.setdefault(phrase, []).append((label, BASE_CONFIDENCE, True))
    for phrase, label, confidence in NOTICES:
        meaning.setdefault(phrase, []).append((label, confidence, False))
    for phrase, what in meaning.items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 1, tuple(what)))
    phrases.make_automaton()
    tags = ahocorasick.Automaton()
    for tag in TAGS:
        tags.add_word(tag, tag)
    tags.make_automaton()
    return phrases, tags


@dataclass
class Scan:
    """What a scan found in one text."""

    n_words: int
    base: list[int]
    base_labels: set[str]
    labels: set[str]
    expressions: list[Expression]
    score: float


def scan_text(text: bytes | None) -> Scan:
    """Scan one UTF-8 text; null counts as empty."""
    phrases, tags = _automata()
    words = (text or b"").translate(_WORDS).split()
    out = Scan(len(words), [], set(), set(), [], 0.0)
    line = b" ".join((b"", *words, b"")).decode()
    miss = 1.0
    at = place = 0  # words are counted on from the find before
    for end, (back, what) in phrases.iter(line):
        for label, confidence, base in what:
            out.labels.add(label)
            miss *= 1 - confidence
            if base:
                start = end - back
                place += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
                at = start
                out.base_labels.add(label)
                out.base.append(place)
    lower = (text or b"").translate(_LOWER)
    if any(tag.encode() in lower for tag in TAGS):
        raw, line_end = lower.decode(), -1
        for end, _ in tags.iter(raw):
            if line_end <= end:
                line_end = len(raw) if (found := raw.find("\n", end + 1)) < 0 else found
            if expression := parse_expression(raw, end + 1, line_end):
                out.expressions.append(expression)
                out.labels |= expression.names()
                miss *= 1 - TAG_CONFIDENCE
    out.score = 1 - miss
    return out


_SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, expressions array<string>, permitted boolean"
)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: word count, places and labels of the base phrases, all labels, score, parsed expressions.

    ``labels`` and ``base_labels`` are distinct, sorted and joined by commas (empty if
    none). ``score`` is one minus the product of the finds' doubts. ``permitted`` says
    whether every expression found can be met by permissive licences (null without one).

    Defined cases: a null text is empty; an empty text has no finds, null
    ``first_word`` and ``last_word`` and score 0; texts and expressions of any length are
    read whole, in time that grows with the length; repeated rows stay; an empty table
    gives an empty result. Rows never meet, and other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            found = [scan_text(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [
                pa.array([s.n_words for s in found], pa.int64()),
                pa.array([len(s.base) for s in found], pa.int64()),
                pa.array([min(s.base, default=None) for s in found], pa.int64()),
                pa.array([max(s.base, default=None) for s in found], pa.int64()),
                pa.array([",".join(sorted(s.base_labels)) for s in found], pa.string()),
                pa.array([",".join(sorted(s.labels)) for s in found], pa.string()),
                pa.array([s.score for s in found], pa.float64()),
                pa.array([[str(e) for e in s.expressions] for s in found], pa.list_(pa.string())),
                pa.array([all(e.allowed() for e in s.expressions) if s.expressions else None for s in found], pa.bool_()),
            ]
            names = [part.split()[0] for part in _SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, f"doc_id {doc_type}, {_SCHEMA}")
