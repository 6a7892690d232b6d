"""Words and their hashes from the bytes of whole texts, in numpy, a bounded piece at a time.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII;
ASCII and Latin-1 letters are compared in lower case. A word's hash is a polynomial of
its bytes, taken from prefix sums, so that no word is cut out as a string.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word


LOWER, IS_WORD = _tables()


def mixed(h: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as long as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 4096)
            up, down = np.full(size, _BASE), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column one after the other, and where each begins and ends."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def row_groups(offsets: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `piece` bytes each; a longer row is alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + piece, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def _piece_words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a piece; no word runs on over a text's beginning."""
    low = LOWER[data]
    latin = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[latin] += 32
    inside = IS_WORD[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = begins[begins < len(data)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_before = begins[begins > 0] - 1
    last[ends_before] = inside[ends_before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin and end among them."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for start, end in row_groups(offsets):
        low, high = int(offsets[start]), int(offsets[end])
        while low < high:
            stop = high
            if high - low > 2 * PIECE:  # one long text: cut where a word ends
                stop = low + PIECE
                while stop < high and IS_WORD[LOWER[data[stop]]]:
                    stop += 1
            begins = offsets[start:end] - low
            found, places = _piece_words(data[low:stop], begins[begins >= 0])
            hashes.append(found)
            row = np.searchsorted(offsets[start:end + 1], places + low, side="right") - 1
            counts[start:end] += np.bincount(row, minlength=end - start)[:end - start]
            low = stop
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), bounds


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of all runs of n words; a shorter text has one run of all its words."""
    total = len(words)
    counts = np.diff(bounds)
    text_of = np.repeat(np.arange(len(counts)), counts)
    left = bounds[1:][text_of] - np.arange(total)  # words from here to the text's end
    h = np.zeros(total, np.uint64)
    for j in range(n):
        if j >= total:
            break
        part = words[j:] * np.uint64(2 * j + 1) + np.uint64(j)
        h[:total - j] = mixed(h[:total - j] ^ part) if counts.size and counts.min() >= n else np.where(
            left[:total - j] > j, mixed(h[:total - j] ^ part), h[:total - j])
    place = np.arange(total) - bounds[:-1][text_of]
    keep = (left >= n) | (place == 0)
    return h[keep], text_of[keep], place[keep]
