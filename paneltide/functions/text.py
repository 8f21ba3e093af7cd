"""Text columns: distances, lines, indents, previews."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from paneltide.functions.binding import let

# Line ends, blanks and the notes of a shortened preview.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BLANK = r"[\s\x1c-\x1f]"
PREVIEW_LENGTH = 500
PREVIEW_GAP = "\n...\n"
PREVIEW_NOTE = "\n\nValue too large to show. This is it's data format:\n\n"


def strip(c: Column) -> Column:
    """Remove blanks of any alphabet at both ends."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{BLANK}+", "")


def split_lines(c: Column) -> Column:
    """Lines of a text; a final line end does not open another line."""
    body = F.regexp_replace(c, rf"(?:{LINE_END})\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END, -1))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the summed lengths, 0 for two empty texts."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / total)


def common_substring_length_short(a: Column, b: Column) -> Column:
    """Longest common substring of two short texts, without leaving the JVM.

    The work grows with the square of ``a``; names and codes are the intended input.
    """
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    size = F.char_length(a)

    def longest_at(start):
        return F.aggregate(
            F.sequence(F.lit(1), size - start + 1),
            F.lit(0),
            lambda best, n: F.when(
                (n == best + 1) & F.contains(b, F.substr(a, start, n)), n
            ).otherwise(best),
        )

    return F.when(size == 0, F.lit(0)).otherwise(
        F.array_max(F.transform(F.sequence(F.lit(1), size), longest_at))
    )


_BASE = np.uint64(1_000_003)


def _window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of every window of ``size`` code points (mod 2**64)."""
    n = len(codes)
    powers = np.ones(n + 1, dtype=np.uint64)
    powers[1:] = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
    prefix = np.zeros(n + 1, dtype=np.uint64)
    prefix[1:] = np.cumsum((codes + np.uint64(1)) * powers[:n])
    windows = prefix[size:] - prefix[: n - size + 1]
    return windows * powers[n - size :: -1][: n - size + 1]


def _longest_common(a: str, b: str) -> int:
    """Binary search on the length; a hash hit counts only after comparing the text."""
    if not a or not b:
        return 0
    xa = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    xb = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    # Both texts are aligned to one length so that equal windows hash equally.
    width = max(len(xa), len(xb))
    xa = np.concatenate([xa, np.zeros(width - len(xa), dtype=np.uint64)])
    xb = np.concatenate([xb, np.zeros(width - len(xb), dtype=np.uint64)])

    def shared(size: int) -> bool:
        ha = _window_hashes(xa, size)[: len(a) - size + 1]
        hb = _window_hashes(xb, size)[: len(b) - size + 1]
        starts = np.flatnonzero(np.isin(ha, hb))
        return any(a[i : i + size] in b for i in starts)

    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if shared(middle) else (low, middle - 1)
    return low


@F.pandas_udf(T.IntegerType())
def _common_substring_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_longest_common(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


def common_substring_length(a: Column, b: Column) -> Column:
    """Longest common substring of whole texts of any length (Arrow batches)."""
    return _common_substring_udf(a, b)


def dedent(c: Column) -> Column:
    """Remove the indent all non-blank lines share; unchanged when there is none."""

    def cut(lines, indent):
        kept = F.transform(
            lines,
            lambda line: F.when(lstrip(line) == "", F.lit("")).otherwise(
                F.substr(line, indent + 1, F.char_length(line))
            ),
        )
        return F.when(F.coalesce(indent, F.lit(0)) == 0, c).otherwise(F.array_join(kept, "\n"))

    def indent_of(lines):
        # Blank lines give NULL, which the minimum skips.
        return F.array_min(
            F.transform(
                lines,
                lambda line: let(
                    F.char_length(lstrip(line)), lambda n: F.when(n > 0, F.char_length(line) - n)
                ),
            )
        )

    return let(split_lines(c), lambda lines: let(indent_of(lines), lambda n: cut(lines, n)))


def drop_import_lines(c: Column, top_only: bool = False) -> Column:
    """Drop lines starting with ``import`` or ``from``, then strip the text."""

    def keep(line):
        head = line if top_only else strip(line)
        return ~(F.startswith(head, F.lit("import ")) | F.startswith(head, F.lit("from ")))

    return strip(F.array_join(F.filter(split_lines(c), keep), "\n"))


def preview(text: Column, note: Column | None = None, max_len: int = PREVIEW_LENGTH) -> Column:
    """First and last half of a text longer than ``max_len``, with a format note."""
    half = max_len // 2
    tail = -(-max_len // 2)
    pieces = [F.substring(text, 1, half), F.lit(PREVIEW_GAP), F.right(text, F.lit(tail))]
    if note is not None:
        pieces += [F.lit(PREVIEW_NOTE), note]
    return F.when(F.char_length(text) > max_len, F.concat(*pieces)).otherwise(text)
