"""License scans: an Aho-Corasick pass for phrases and tags, a shunting-yard parser for licence expressions.

Texts are matched over their words: A-Z lowered, a word being a longest run of digits, letters and non-ASCII
characters. One automaton holds the notice phrases and the identifier tag; each place of the tag hands the rest of its
line to the expression parser, which gives ``and`` / ``or`` / ``with`` in postfix order, and all licences named in it.

Where an expression takes all of its line, every identifier in it names a licence. Where prose follows (``see below``,
``MIT for this file``), only those do whose family is known or that hold a digit, a hyphen or a plus sign, as registered
identifiers do. ``NONE`` and ``NOASSERTION`` name none.

Cases: null and empty texts have no word and no place; an expression that does not parse names the identifiers read up
to the fault; a phrase that overlaps another counts at each place; score is 0 without evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import batches

# The contract's base phrases and labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases of well-known licences, and how sure each makes us.
NOTICE_PHRASES = {
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
    "this is free and unencumbered software": "unlicense",
}
TAG_PHRASE = "spdx license identifier"
# Identifier families: what an identifier starts with → label.
FAMILIES = {
    "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "apache": "apache", "mit": "mit", "bsd": "bsd", "mpl": "mpl",
    "isc": "isc", "epl": "epl", "bsl": "bsl", "cc0": "cc0", "unlicense": "unlicense", "cc-by": "cc-by",
}
_SPACE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_TAG = "spdx-license-identifier:"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LINE_END = re.compile(rb"[\r\n]")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(line: str) -> tuple[list[str], bool]:
    """A licence expression in postfix order (shunting-yard; ``with`` binds tightest, then ``and``, then ``or``).

    Returns the postfix tokens and whether the whole expression was well-formed; reading stops at the first fault.
    """
    return _parse(line)[:2]


def _parse(line: str) -> tuple[list[str], bool, bool]:
    """:func:`parse_expression`, and whether an operand follows where the expression had ended: prose."""
    output: list[str] = []
    stack: list[str] = []
    expects_operand, whole, prose = True, True, False
    for token in _TOKEN.findall(line):
        word = token.lower()
        if expects_operand:
            if token == "(":
                stack.append(token)
            elif token == ")" or word in _RANK:
                whole = False
                break
            else:
                output.append(token)
                expects_operand = False
        elif word in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                output.append(stack.pop())
            stack.append(word)
            expects_operand = True
        elif token == ")":
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if not stack:
                whole = False
                break
            stack.pop()
        else:
            whole, prose = "(" not in stack, True
            break
    if expects_operand:
        whole = False
        if stack and stack[-1] in _RANK:
            stack.pop()
    while stack:
        top = stack.pop()
        if top == "(":
            whole = False
        else:
            output.append(top)
    return output, whole, prose


def evaluate(postfix: list[str]) -> list[frozenset[str]]:
    """The ways to satisfy an expression: alternatives (``or``), each a set of licences that hold together.

    ``with`` joins an exception to its licence as ``licence with exception``. All alternatives are listed, and every
    and-ed choice multiplies them; who needs the licences alone takes :func:`licences_named`.
    """
    stack: list[list[frozenset[str]]] = []
    for token in postfix:
        if token in _RANK and len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            if token == "or":
                joined = left + right
            elif token == "and":
                joined = [a | b for a in left for b in right]
            else:
                joined = [frozenset(f"{x} with {y}" for x in a for y in b) for a in left for b in right]
            stack.append(list(dict.fromkeys(joined)))
        elif token not in _RANK:
            stack.append([frozenset([token.lower()])])
    return [choice for item in stack for choice in item]


def licences_named(postfix: list[str]) -> set[str]:
    """The licences in an expression, without their exceptions; no alternatives are expanded."""
    stack: list[set[str]] = []
    for token in postfix:
        if token in _RANK and len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            if token != "with":
                left, right = (left, right) if len(left) >= len(right) else (right, left)
                left |= right
            stack.append(left)
        elif token not in _RANK:
            stack.append({token.lower()})
    return set().union(*stack)


def family(identifier: str) -> str:
    """The label of one identifier, its own lower-case text if its family is unknown."""
    name = identifier.lower().split(" with ")[0]
    return next((label for prefix, label in sorted(FAMILIES.items(), key=lambda x: -len(x[0])) if name.startswith(prefix)), name.rstrip("+"))


def is_licence(identifier: str) -> bool:
    """Whether an identifier can name a licence: a known family, or a digit, hyphen or plus sign among its letters."""
    name = identifier.lower()
    if any(name == prefix or re.match(rf"{re.escape(prefix)}[^a-z]", name) for prefix in FAMILIES):
        return True
    return any(c in "0123456789-+" for c in name) and any(c.isalpha() for c in name)


def expression_labels(line: str) -> list[str]:
    """Labels of all licences that an expression names."""
    postfix, _, prose = _parse(line)
    return sorted({family(name) for name in licences_named(postfix) if name not in ("none", "noassertion") and (not prose or is_licence(name))})


class Scanner:
    """The automaton of phrases and the tag over a text's words, and that of the tag over its bytes as they stand."""

    def __init__(self, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton):
        self.phrases, self.tags = phrases, tags

    def tagged_lines(self, text: str) -> list[str]:
        """What follows each place of the tag on its line."""
        raw = text.encode("utf-8", "replace")
        out = []
        for end, _ in self.tags.iter(raw.translate(_LOWER).decode("latin-1")):  # a character a byte: places are the bytes'
            stop = _LINE_END.search(raw, end + 1)
            out.append(raw[end + 1 : stop.start() if stop else len(raw)].decode("utf-8", "replace"))
        return out


def build_automaton() -> Scanner:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, known in (("notice", NOTICE_PHRASES), ("base", BASE_PHRASES)):
        for phrase, label in known.items():
            phrases.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    phrases.add_word(f" {TAG_PHRASE} ", ("tag", "", len(TAG_PHRASE) + 2))
    tags.add_word(_TAG, "")
    phrases.make_automaton()
    tags.make_automaton()
    return Scanner(phrases, tags)


def scan_text(scanner: Scanner, text: str | None) -> dict:
    """Every finding in one text: number of words, base places, labels, notice spans and expressions."""
    words = (text or "").encode("utf-8", "replace").translate(_SPACE).split()
    line = b" ".join([b"", *words, b""]).decode("utf-8")
    base: list[int] = []
    base_labels, labels, spans = set(), set(), []
    tagged = False
    places: dict[int, int] = {}
    seen = place = 0
    found = list(scanner.phrases.iter(line))
    for start in sorted({end - length + 1 for end, (_, _, length) in found}):  # each stretch counts once
        place += line.count(" ", seen, start)
        seen, places[start] = start, place
    for end, (kind, label, length) in found:
        place = places[end - length + 1]
        if kind == "base":
            base.append(place)
            base_labels.add(label)
        if kind == "tag":
            tagged = True
        else:
            labels.add(label)
            spans.append((place, label))
    expressions = []
    if tagged:
        for rest in scanner.tagged_lines(text):
            expressions.append(rest.strip())
            labels.update(expression_labels(rest))
    evidence = 1.0 if expressions and labels else 0.0
    if spans:
        evidence = max(evidence, 1 - 0.5 ** (1 + len({place for place, _ in spans})))
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(base) if base else None, "last_word": max(base) if base else None,
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": evidence,
        "spans": sorted(spans), "expressions": expressions,
    }


_FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<word:long,label:string>>, expressions array<string>"


def scan_licenses(docs: DataFrame, id_cols: list[str], text: str = "text") -> DataFrame:
    """``id_cols`` with every licence finding of each text. No shuffle; one row is in memory at a time."""
    names = [x.split()[0] for x in _FOUND.split(", ")]
    span = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), span, pa.list_(pa.string())]

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = build_automaton()
        for batch in batches(source):
            found = [scan_text(scanner, x.as_py()) for x in batch.column(batch.num_columns - 1)]
            for x in found:
                x["spans"] = [{"word": p, "label": label} for p, label in x["spans"]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([x[n] for x in found], t) for n, t in zip(names, types, strict=True))], names=[*batch.schema.names[:-1], *names])

    picked = docs.select(*id_cols, F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    return picked.mapInArrow(scan, ", ".join([*fields, _FOUND]))
