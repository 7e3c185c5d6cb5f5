"""License scans: Aho-Corasick over whole texts, and a shunting-yard expression parser.

A text is taken as UTF-8 bytes with A-Z lower-cased. One automaton finds the phrases of
``PHRASES`` and ``NOTICES`` at word boundaries, another the identifier tags; after a tag
the licence expression (``and``, ``or``, ``with``, parentheses) is parsed to postfix
form and evaluated. Only known identifiers are operands, an exception's name only after
``with``; the expression ends before the first word that does not fit, so prose behind it
is not read as licences.

Defined cases: a null or empty text has no words, no labels and score 0; a word is a
maximal run of digits, letters a-z and bytes from 0x80; overlapping places all count;
an expression that is malformed or names no known licence yields the known identifiers
in it, with a low score; very
long texts are scanned whole; repeated rows are scanned alike; an empty table gives an
empty result; other columns are untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of the method and their labels.
NOTICES = {
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "boost",
    "creative commons": "cc",
    "licensed under cc by": "cc",
    "permission is hereby granted free of charge": "mit",
    "all rights reserved": "reserved",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "common development and distribution license": "cddl",
    "open font license": "ofl",
    "python software foundation license": "psf",
    "released into the public domain": "public-domain",
    "do what you want to public license": "wtfpl",
}
#: Identifier tags, lower-cased.
TAGS = ("spdx-license-identifier:", "license-expression:", "license-id:")
#: Beginnings of licence identifiers and their labels; the longest wins.
FAMILIES = {"0bsd": "bsd", "agpl": "agpl", "apache": "apache", "artistic": "artistic", "bsd": "bsd", "bsl": "boost", "cc": "cc", "cc0": "cc0", "cddl": "cddl", "epl": "epl", "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "ofl": "ofl", "psf": "psf", "python": "psf", "unlicense": "unlicense", "wtfpl": "wtfpl", "zlib": "zlib", "licenseref": "other"}
#: What may follow a family in an identifier, besides versions.
SUFFIXES = ("clause", "only", "or", "later", "new", "no", "copyleft", "exception", "by", "sa", "nc", "nd", "attribution", "patent", "views", "modification", "perl", "libpng", "acknowledgement", "shortened", "pd", "igo", "clear", "rfn")
#: Families whose terms a permissive policy accepts.
PERMISSIVE = ("0bsd", "apache", "bsd", "boost", "cc0", "isc", "mit", "unlicense", "zlib")
RANK = {"or": 1, "and": 2, "with": 3}
#: Score of the strongest evidence found.
SCORES = {"tag": 1.0, "phrase": 0.8, "notice": 0.6, "broken tag": 0.3}

_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+\-]*")
_VERSION = r"v?\d+(?:\.\d+)*"
_KNOWN = re.compile(rf"licenseref-[a-z0-9.\-]+|(?:{'|'.join(sorted(FAMILIES, key=len, reverse=True))})(?:{_VERSION})?(?:-(?:{_VERSION}|{'|'.join(SUFFIXES)}))*\+?")
_EXCEPTION = re.compile(rf"(?:[a-z0-9.]+-)+exception(?:-{_VERSION})?")

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_())])


def family(identifier: str) -> str:
    """Label of a licence identifier such as ``apache-2.0``; an unknown one is its own label."""
    known = [k for k in FAMILIES if identifier.startswith(k)]
    return FAMILIES[max(known, key=len)] if known else identifier


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators by rank, all left-associative; ValueError if malformed."""
    out, held, operand_next = [], [], True
    for t in tokens:
        if t == "(":
            if not operand_next:
                raise ValueError("operator expected")
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held or operand_next:
                raise ValueError("unbalanced")
            held.pop()
        elif t in RANK:
            if operand_next:
                raise ValueError("operand expected")
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[t]:
                out.append(held.pop())
            held.append(t)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError("operator expected")
            out.append(t)
            operand_next = False
    if operand_next or "(" in held:
        raise ValueError("incomplete")
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Labels that the expression names, and whether a permissive policy can accept it.

    ``or`` needs one acceptable side, ``and`` both; ``with`` binds an exception to the
    licence at its left and leaves its verdict.
    """
    stack: list[tuple[set[str], bool]] = []
    for t in postfix:
        if t in RANK:
            right, left = stack.pop(), stack.pop()
            if t == "with":  # the right side names an exception
                stack.append(left)
            else:
                stack.append((left[0] | right[0], (left[1] or right[1]) if t == "or" else (left[1] and right[1])))
        else:
            label = family(t)
            stack.append(({label}, label in PERMISSIVE))
    return stack[0]


def read_expression(text: str) -> tuple[str, list[str] | None]:
    """The expression at the start of ``text`` (rest of a line): its source and postfix form or None."""
    line = re.match(r"[ \t]*([a-z0-9.+\-() \t]*)", text)[1]
    tokens = [t.rstrip(".") if t not in "()" else t for t in _TOKEN.findall(line)]
    end, stop, depth, operand_next, exception = 0, len(tokens), 0, True, False
    for i, t in enumerate(tokens):
        if t == "(":
            fits, depth = operand_next and not exception, depth + 1
        elif t == ")":
            fits, depth = not operand_next and depth > 0, depth - 1
        elif t in RANK:
            fits, operand_next, exception = not operand_next, True, t == "with"
        else:
            fits = operand_next and bool((_EXCEPTION if exception else _KNOWN).fullmatch(t))
            operand_next = exception = False
        if not fits:
            stop = i
            break
        if depth == 0 and not operand_next:
            end = i + 1
    if end:
        return " ".join(tokens[:end]), to_postfix(tokens[:end])
    return " ".join(tokens[:stop]), None


class Scanner:
    """Both automata; one for each Python worker."""

    def __init__(self) -> None:
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        for group, base in ((PHRASES, True), (NOTICES, False)):
            for phrase, label in group.items():
                self.phrases.add_word(f" {phrase} ", (base, label, len(phrase) + 1))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple:
        raw = (text or "").encode()
        # single spaces between words and around them: latin-1 gives one character a byte
        found = raw.translate(_FOLD).split()
        flat = b" %b " % b" ".join(found)
        starts, base, more = [], set(), set()
        at = counted = 0
        for end, (is_base, label, width) in self.phrases.iter(flat.decode("latin-1")):
            if is_base:
                start = end - width
                counted += flat.count(b" ", at, start)  # spaces before it, less the first: the word's number
                at = start
                starts.append(counted)
                base.add(label)
            else:
                more.add(label)
        expressions, permissive, scores = [], None, {0.0, SCORES["notice"] * bool(more)}
        lowered = raw.lower()
        if any(t.encode() in lowered for t in TAGS):
            view = lowered.decode("latin-1")
            for end, _ in self.tags.iter(view):
                stop = view.find("\n", end)
                source, postfix = read_expression(view[end + 1 : stop if stop >= 0 else None])
                if postfix is None:
                    more |= {family(t) for t in _TOKEN.findall(source) if _KNOWN.fullmatch(t)}
                    scores.add(SCORES["broken tag"])
                else:
                    labels, ok = evaluate(postfix)
                    more |= labels
                    permissive = ok if permissive is None else permissive and ok
                    scores.add(SCORES["tag"])
                expressions.append(source)
        if base:
            scores.add(SCORES["phrase"])
        return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), max(scores), expressions, permissive


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document; see ``SCHEMA``. Map-only: texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows = [scanner.scan(t.as_py()) for t in texts]
            columns = [ids, *([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 9)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
