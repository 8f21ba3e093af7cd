"""Sets of five-word shingles as sorted 64-bit hashes, vectorised over many texts.

Words are runs without ASCII white space, with A-Z lowered.  A word's hash is a polynomial
in its bytes, mixed with its length; a shingle's hash mixes those of its five words in
order.  A text with fewer words has one shingle, the whole sequence; one without words has
none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes worked on at once; a longer text is cut at white space and its words put together.
PIECE = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_LOWER[_SPACE] = np.uint64(0)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_FACTORS = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _powers(step: int, count: int) -> np.ndarray:
    out = np.empty(count, dtype=np.uint64)
    value = 1
    for i in range(count):
        out[i] = value
        value = value * step & _MASK
    return out


_NEAR = _powers(_BASE, 1 << 12)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word."""
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    spans = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    weights = _NEAR[place & 0xFFF]
    longest = int((ends - starts).max())
    if longest > len(_NEAR):
        far = _powers(pow(_BASE, len(_NEAR), 1 << 64), (int(place.max()) >> 12) + 1)
        weights = weights * far[place >> 12]
    sums = np.add.reduceat(_LOWER[raw[starts[0] :]] * weights, starts - starts[0])
    return _mix(sums + (ends - starts).astype(np.uint64) * _FACTORS[0]), starts


def _long_text(data: bytes) -> np.ndarray:
    """Word hashes of one text of any length, in pieces cut at white space."""
    raw = np.frombuffer(data, dtype=np.uint8)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw):
            gap = np.flatnonzero(_SPACE[raw[end : end + PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(raw), end + PIECE)
        out.append(_words(raw[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _sets(words: np.ndarray, bounds: list[int]) -> Iterator[np.ndarray]:
    n = len(words)
    grams = None
    if n >= WIDTH:
        grams = words[: n - WIDTH + 1] * _FACTORS[0]
        for i in range(1, WIDTH):
            grams = grams + words[i : n - WIDTH + 1 + i] * _FACTORS[i]
        grams = _mix(grams)
    for low, high in zip(bounds[:-1], bounds[1:]):
        count = high - low
        if count >= WIDTH:
            own = np.sort(grams[low : high - WIDTH + 1])
            fresh = np.empty(len(own), dtype=bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            yield own[fresh]
        elif count:
            whole = np.uint64(count)
            with np.errstate(over="ignore"):
                for i in range(count):
                    whole = whole + words[low + i] * _FACTORS[i]
                yield _mix(np.array([whole ^ np.uint64(0x5555555555555555)]))
        else:
            yield np.empty(0, dtype=np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; NULL and empty texts have none."""
    group: list[bytes] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        if not group:
            return
        ends = np.cumsum([len(g) + 1 for g in group])
        words, starts = _words(np.frombuffer(b" ".join(group), dtype=np.uint8))
        yield from _sets(words, [0, *np.searchsorted(starts, ends).tolist()])
        group.clear()

    for text in texts:
        data = (text or "").encode()
        if held + len(data) > PIECE:
            yield from flush()
            held = 0
        if len(data) > PIECE:
            words = _long_text(data)
            yield from _sets(words, [0, len(words)])
            continue
        group.append(data)
        held += len(data) + 1
    yield from flush()
