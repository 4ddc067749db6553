"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates
the licence expressions behind the tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hybridlake.llm.texts import documents

# The phrases every scan looks for, as words, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices. The score says how freely a text under the label may be used (1: freely).
NOTICES = {
    "licensed under the apache license": "apache", "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd", "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl", "affero general public license": "agpl",
    "released into the public domain": "public-domain", "cc0": "cc0", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd", "proprietary and confidential": "proprietary", "mit license": "mit", "bsd license": "bsd",
}
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "zlib": 0.9, "apache": 0.9, "unlicense": 1.0,
    "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2,
    "cc-by-nd": 0.2, "proprietary": 0.0, "reserved": 0.0,
}
UNKNOWN = 0.1        # an identifier that is not listed
UNLICENSED = 0.5     # no label at all
EXCEPTION = 0.1      # what a ``with`` exception adds
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")
OPERATORS = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*|[^\s]")

_SEPARATORS = bytes(i for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased; none for NULL."""
    return text.encode("utf-8").lower().translate(_TO_SPACE).split() if text else []


@dataclass(frozen=True)
class Terms:
    """Value of an expression: how freely it may be used, and the labels it names."""

    freedom: float
    labels: frozenset[str] = field(default_factory=frozenset)


def identifier(name: str) -> Terms:
    """``mit``, ``apache-2.0``, ``gpl-3.0-or-later``: the longest listed label that the identifier starts with."""
    parts = name.rstrip("+").split("-")
    for n in range(len(parts), 0, -1):
        label = "-".join(parts[:n])
        if label in FREEDOM:
            return Terms(FREEDOM[label], frozenset([label]))
    return Terms(UNKNOWN, frozenset([f"other:{name}"]))


def evaluate(expression: str) -> Terms | None:
    """Value of a licence expression; None if there is none."""
    return parse(expression, 0, len(expression))[0]


def parse(text: str, start: int, stop: int) -> tuple[Terms | None, int]:
    """Value and end of the licence expression that ``text[start:stop]`` begins with, by two stacks; ``with`` binds before ``and``, ``and`` before ``or``.

    ``or`` leaves the choice of the freer side, ``and`` binds to the stricter, ``with`` eases what it follows. Reading
    ends where the text can no longer be an expression; what was read up to there counts. None if nothing was.
    """
    values: list[Terms] = []
    operators: list[str] = []
    operand = True  # an identifier or an opening bracket comes next

    def apply() -> None:
        name = operators.pop()
        right, left = values.pop(), values.pop()
        if name == "with":
            values.append(Terms(min(1.0, left.freedom + EXCEPTION), left.labels))
        else:
            pick = max if name == "or" else min
            values.append(Terms(pick(left.freedom, right.freedom), left.labels | right.labels))

    end = start
    for found in TOKEN.finditer(text, start, stop):  # the rest is not read after a break
        token = found[0]
        if token == "(":
            if not operand:
                break
            operators.append(token)
        elif token == ")":
            if operand or "(" not in operators:
                break
            while operators[-1] != "(":
                apply()
            operators.pop()
        elif token in OPERATORS:
            if operand:
                break
            while operators and operators[-1] != "(" and OPERATORS[operators[-1]] >= OPERATORS[token]:
                apply()
            operators.append(token)
            operand = True
        elif operand and token[0].isalnum():
            values.append(identifier(token))
            operand = False
        else:
            break
        end = found.end()
    if operand and operators and operators[-1] != "(":  # an operator that nothing follows
        operators.pop()
    while operators:
        if operators[-1] == "(":
            operators.pop()
        elif len(values) < 2:
            break
        else:
            apply()
    return (values[-1] if values else None), end


class Scanner:
    """Both automata; built once per worker from tables of fixed size."""

    def __init__(self, phrases: dict[str, str], base: dict[str, str]) -> None:
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, label in {**phrases, **base}.items():
            self.phrases.add_word(f" {phrase} ", (f" {phrase} ", label, phrase in base))
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple:
        found = words(text)
        line = f" {b' '.join(found).decode('utf-8')} "
        places: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        for end, (phrase, label, is_base) in self.phrases.iter(line):
            labels.add(label)
            if is_base:
                base.add(label)
                places.append(end + 1 - len(phrase))
        terms = [identifier(label).freedom for label in labels]
        expressions: list[str] = []
        lowered = text.lower() if " license identifier " in line or "expression " in line else ""
        stop = -1
        for end, _ in self.tags.iter(lowered):
            if stop <= end:
                stop = lowered.find("\n", end)
                stop = len(lowered) if stop < 0 else stop
            value, to = parse(lowered, end + 1, stop)
            if value is not None:
                labels |= value.labels
                terms.append(value.freedom)
                expressions.append(lowered[end + 1:to].strip())
        first = line.count(" ", 0, min(places)) if places else None
        last = line.count(" ", 0, max(places)) if places else None
        return (len(found), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)),
                min(terms, default=UNLICENSED), expressions)


FIELDS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, expressions array<string>")


def scanned(text: Column | str, phrases: dict[str, str] | None = None) -> Column:
    """Struct of findings of a text: its number of words, the places of the base phrases, labels, the freedom score
    (least of all notices and expressions found) and the expressions behind identifier tags.

    NULL and empty texts have no words, no labels and the score of unlicensed texts. Phrases count wherever their words
    stand consecutively, overlapping places too. Texts are read whole, whatever their length; an expression ends with its
    line, or before it where the words are none. Each row is scanned by itself: repeated rows agree, an empty table gives
    none, and other columns are left as they are.
    """
    known = NOTICES if phrases is None else phrases

    @F.pandas_udf(FIELDS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(known, BASE_PHRASES)
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for texts in batches:
            rows = pd.DataFrame([scanner.scan(t) for t in texts], columns=names)
            yield rows.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan(text)


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence findings of every document."""
    docs = documents(spark, sf_dir).select("doc_id", scanned("text").alias("found"))
    return docs.select("doc_id", "found.*").drop("expressions")
