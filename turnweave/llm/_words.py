"""Words of an Arrow column as 64-bit hashes, by numpy over the column's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes looked at in one go; a window ends between words, so a longer word makes a longer window.
WINDOW = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def separators(kept_ascii: bytes | None = None) -> np.ndarray:
    """Which bytes end a word: white space, or else all of ASCII but those given. Bytes of other characters never do."""
    out = np.zeros(256, bool)
    if kept_ascii is None:
        out[[0x20, *range(0x09, 0x0E)]] = True
    else:
        out[:128] = True
        out[list(kept_ascii)] = False
    return out


WHITE_SPACE = separators()
NOT_ALPHANUMERIC = separators(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=_U)


_POWERS = _powers(WINDOW + 1, _BASE), _powers(WINDOW + 1, pow(_BASE, -1, 1 << 64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _POWERS if n <= WINDOW else (_powers(n + 1, _BASE), _powers(n + 1, pow(_BASE, -1, 1 << 64)))


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes with A-Z in lower case, and the offsets of its rows; a null is empty."""
    column = pc.ascii_lower(column.fill_null("")).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def windows(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """(row of each word, its start, its end, (prefix sums, inverse powers)) by windows of whole words, in order."""
    low, last = int(offsets[0]), int(offsets[-1])
    while low < last:
        high = min(low + WINDOW, last)
        while high < last and not ends_word[data[high - 1]]:
            # back to a separator or the start of a row; if there is none, on to the next
            here = np.flatnonzero(ends_word[data[low:high]])
            row = offsets[np.searchsorted(offsets, high, "right") - 1]
            back = max(low + here[-1] + 1 if len(here) else low, row if row > low else low)
            if back > low:
                high = int(back)
                break
            high = min(high + WINDOW, last)
        part = data[low:high]
        word = ~ends_word[part]
        cut = np.zeros(len(part) + 1, bool)
        inside = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, "right")]
        cut[inside - low] = True
        before, after = np.ones(len(part), bool), np.ones(len(part), bool)
        before[1:] = ~word[:-1]
        after[:-1] = ~word[1:]
        starts = np.flatnonzero(word & (before | cut[:-1]))
        ends = np.flatnonzero(word & (after | cut[1:])) + 1
        powers, inverse = _powers_to(len(part))
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(_BYTE[part] * powers[: len(part)], dtype=_U, out=sums[1:])
        rows = np.searchsorted(offsets, low + starts, "right") - 1
        yield rows, starts, ends, (sums, inverse)
        low = high


def span_hash(starts: np.ndarray, ends: np.ndarray, sums: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hashes of byte ranges of a window; equal bytes give equal hashes wherever they stand."""
    prefix, inverse = sums
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(_BASE))


def word_hashes(column: pa.Array, ends_word: np.ndarray = WHITE_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offset of each row's words) in order; A-Z count as a-z."""
    data, offsets = lowered(column)
    hashes, rows = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for row, starts, ends, sums in windows(data, offsets, ends_word):
        hashes.append(span_hash(starts, ends, sums))
        rows.append(row)
    counts = np.bincount(np.concatenate(rows), minlength=len(column))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
