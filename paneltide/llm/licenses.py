"""License scans (operator 12): Aho-Corasick over words, shunting-yard over expressions.

A text is lowered, cut into words and written with one space around each, so that one
automaton finds notice phrases and identifier tags as whole words, whatever stood between
them.  Behind an announcing tag (``SPDX-License-Identifier``, ``licensed under``) the raw text is
read as an expression: a shunting-yard parser orders ``WITH`` before ``AND`` before ``OR``
and evaluates it, ``AND`` being as strict as its strictest and ``OR`` as its mildest side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paneltide.llm.common import arrow_session, free_name, slices, text_of, worker_state

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: How strict each label is, from 0 (free) to 1 (nothing allowed).
STRICT = {
    "cc0": 0.05, "public-domain": 0.05, "unlicense": 0.05, "mit": 0.2, "bsd": 0.2, "isc": 0.2, "zlib": 0.2, "apache": 0.25, "cc-by": 0.3,
    "mpl": 0.5, "lgpl": 0.5, "epl": 0.5, "cddl": 0.5, "cc-by-sa": 0.6, "gfdl": 0.6, "gpl": 0.75, "agpl": 0.85, "cc-by-nc": 0.9, "cc-by-nd": 0.9,
    "proprietary": 1.0, "reserved": 1.0,
}
#: What an exception after WITH leaves of a license's strictness.
WITH_EXCEPTION = 2 / 3

#: Notices and spelled-out identifiers, as words, and their labels.
NOTICES = {
    "apache license": "apache", "apache 2 0": "apache", "mit license": "mit", "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc", "zlib license": "zlib", "mozilla public license": "mpl", "mpl 2 0": "mpl", "eclipse public license": "epl",
    "epl 2 0": "epl", "common development and distribution license": "cddl", "lesser general public license": "lgpl",
    "library general public license": "lgpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "affero general public license": "agpl", "agpl 3 0": "agpl",
    "gnu gpl": "gpl", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "gplv2": "gpl", "gplv3": "gpl", "free documentation license": "gfdl",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0", "creative commons zero": "cc0",
    "creative commons attribution": "cc-by", "attribution sharealike": "cc-by-sa", "attribution share alike": "cc-by-sa",
    "attribution noncommercial": "cc-by-nc", "attribution non commercial": "cc-by-nc", "attribution noderivatives": "cc-by-nd",
    "public domain": "public-domain", "the unlicense": "unlicense", "proprietary and confidential": "proprietary",
    "alle rechte vorbehalten": "reserved", "tous droits réservés": "reserved", "todos los derechos reservados": "reserved",
}
#: Tags behind which an expression stands.
TAGS = ("spdx license identifier", "license expression", "licensed under")

#: Identifiers in an expression: the first pattern that matches all of one names its label.
IDENTIFIERS = [
    (r"mit(-0)?", "mit"), (r"apache-[12]\.[01]", "apache"), (r"0?bsd(-[1-4]-clause.*)?", "bsd"), (r"isc", "isc"), (r"zlib", "zlib"),
    (r"mpl-[12]\.[01]", "mpl"), (r"epl-[12]\.0", "epl"), (r"cddl-1\.[01]", "cddl"), (r"lgpl-[23]\.[01].*", "lgpl"), (r"agpl-[13]\.0.*", "agpl"),
    (r"gpl-[123]\.0.*", "gpl"), (r"gfdl-1\.[123].*", "gfdl"), (r"cc0-1\.0", "cc0"), (r"cc-by-nc.*", "cc-by-nc"), (r"cc-by-nd.*", "cc-by-nd"),
    (r"cc-by-sa.*", "cc-by-sa"), (r"cc-by-[1-4]\.[05].*", "cc-by"), (r"unlicense", "unlicense"), (r"licenseref-proprietary", "proprietary"),
]
_IDENTIFIER = re.compile("|".join(f"(?P<g{i}>{p})" for i, (p, _) in enumerate(IDENTIFIERS)))
_TOKEN = re.compile(rb"[\x20\t*:'\"]*([()]|[A-Za-z0-9][A-Za-z0-9.\-]*\+?)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}

# Bytes of words; every byte of a character beyond ASCII is one.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[~_IN_WORD] = 0x20


def license_of(identifier: str) -> str | None:
    """Label of an identifier such as ``Apache-2.0`` or ``GPL-2.0-or-later``."""
    found = _IDENTIFIER.fullmatch(identifier.lower().rstrip("+").rstrip("."))
    return IDENTIFIERS[int(found.lastgroup[1:])][1] if found else None


def evaluate(raw: bytes, start: int = 0) -> tuple[set[str], float, int] | None:
    """Labels, strictness and end of the expression at ``start``; None if there is none.

    An expression ends at the first token that cannot continue it.  Open parentheses are
    closed there, and operators without a right side are dropped.
    """
    output: list[float] = []
    stack: list[str] = []
    labels: set[str] = set()
    end, at, want_operand = start, start, True

    def reduce() -> None:
        op, right, left = stack.pop(), output.pop(), output.pop()
        output.append(max(left, right) if op == "and" else min(left, right) if op == "or" else left * right)

    opened = 0
    while found := _TOKEN.match(raw, at):
        word = found[1].decode("ascii")
        low = word.lower()
        if want_operand:
            if word == "(" and stack[-1:] != ["with"]:
                stack.append(word)
                opened += 1
            elif stack and stack[-1] == "with":
                if word in ("(", ")") or low in _PRECEDENCE:
                    break
                output.append(WITH_EXCEPTION)  # any name may be an exception's
                want_operand, end = False, found.end()
            elif label := license_of(word):
                output.append(STRICT[label])
                labels.add(label)
                want_operand, end = False, found.end()
            else:
                break
        elif low in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                reduce()
            stack.append(low)
            want_operand = True
        elif word == ")" and opened:
            while stack[-1] != "(":
                reduce()
            stack.pop()
            opened -= 1
            end = found.end()
        else:
            break
        at = found.end()
    if not output:
        return None
    while want_operand:  # the last operator waits for an operand that does not come
        want_operand = stack.pop() == "("
    while stack:
        if stack[-1] == "(":
            stack.pop()
        else:
            reduce()
    return labels, output[0], end


def automaton(base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...]) -> ahocorasick.Automaton:
    """All phrases as whole words; the value of one lists (kind, label, number of words)."""
    values: dict[str, list[tuple[str, str, int]]] = {}
    for kind, phrases in (("base", base), ("notice", notices), ("tag", dict.fromkeys(tags, ""))):
        for phrase, label in phrases.items():
            key = f" {phrase} ".encode().decode("latin-1")
            values.setdefault(key, []).append((kind, label, phrase.count(" ") + 1))
    machine = ahocorasick.Automaton()
    for key, value in values.items():
        machine.add_word(key, value)
    machine.make_automaton()
    return machine


def scan(text: str, machine: ahocorasick.Automaton) -> tuple:
    """Number of words and base places, first and last place, base labels, all labels, strictness."""
    raw = text.encode()
    codes = np.frombuffer(raw, dtype=np.uint8)
    word = np.zeros(len(codes) + 2, dtype=bool)
    word[1:-1] = _IN_WORD[codes]
    starts, ends = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[:-1] & ~word[1:])
    # Words with one space behind each: word bytes, and the byte after a word as a space.
    kept = word[1:-1] | word[:-2]
    line = " " + _LOWER[codes[kept]].tobytes().decode("latin-1") + " "
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    strict, known, at = 0.0, 0, 1
    found: list[tuple[int, str]] = []
    covered: list[tuple[int, int]] = []
    for end, values in machine.iter(line):
        # A match ends with the space that closes its last word: words so far.
        known += line.count(" ", at, end + 1)
        at = end + 1
        for kind, label, length in values:
            first = known - length
            if kind == "tag":
                behind = int(ends[first + length - 1])
                if result := evaluate(raw, behind):
                    labels |= result[0]
                    strict = max(strict, result[1])
                    covered.append((behind, result[2]))
                continue
            labels.add(label)
            found.append((int(starts[first]), label))
            if kind == "base":
                base.add(label)
                places.append(first)
    # What an expression names is judged by the expression: one side of an OR may be stricter.
    # Expressions come in order of their places, and so do they end.
    inside = np.array(covered, dtype=np.int64).reshape(-1, 2)
    for place, label in found:
        i = int(np.searchsorted(inside[:, 0], place, side="right")) - 1
        if i < 0 or place >= inside[i, 1]:
            strict = max(strict, STRICT[label])
    return len(starts), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), strict


#: Bytes of text worked on at once.
PIECE = 1 << 24
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = worker_state()
    if not hasattr(state, "licenses"):
        state.licenses = automaton(BASE, NOTICES, TAGS)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [x.split()[0] for x in RESULT.split(", ")]
    for whole in batches:
        for batch in slices(whole, whole.schema.names[1], PIECE):
            rows = [scan(t, state.licenses) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [whole.schema.names[0], *names]
            )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    ``n_base`` counts all places of base phrases, overlapping ones too; ``first_word`` and
    ``last_word`` are the smallest and largest word number one starts at, NULL without any.
    ``score`` tells how strict the terms found are: 0 without any, 1 for reserved rights, the
    strictest of all notices and evaluated expressions.  NULL and empty texts have no words
    and no labels.  Repeated rows give repeated rows; NULL ids are kept; further columns are
    ignored; an empty table gives no rows.
    """
    arrow_session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = free_name(docs.select(id_col), "text")
    return docs.select(id_col, text_of(F.col(text_col)).alias(text)).mapInArrow(_scan_batches, f"`{id_col}` {kind}, {RESULT}")
