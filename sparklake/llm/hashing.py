"""Words and word shingles of many texts at once, as 64-bit hashes in flat numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import flat

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, U)

#: Words by white space: space, tab, line feed, vertical tab, form feed, carriage return end a word.
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
#: Words by letters and digits: ASCII that is neither ends a word; bytes of other scripts don't.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: With MARKS these end words too: the UTF-8 of U+00A0 to U+00BF, U+2000 to U+207F and U+3000 to U+303F.
PUNCTUATION = ((0xC2, (0xA0, 0xBF)), (0xE2, (0x80, 0x81)), (0xE3, (0x80, 0x80)))
#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> np.ndarray:
    """The base to the powers 0 to n - 1, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        b = np.full(max(n, 1024), _BASE, U)
        b[0] = 1
        _powers = np.multiply.accumulate(b)
    return _powers


def words(strings: pa.Array, ends: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, row) of every word, in order; ASCII letters count as lower case.

    ends says of each byte whether it separates words. The byte position is within the row's text.
    """
    data, offsets = flat(strings)
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~ends[data]
    if ends is MARKS:
        for lead, second in PUNCTUATION:
            at = np.flatnonzero(data == lead)
            at = at[at + 1 < len(data)]
            at = at[(data[at + 1] >= second[0]) & (data[at + 1] <= second[1])]
            for j in range(2 if lead < 0xE0 else 3):
                inside[np.minimum(at + j, len(data) - 1)] = False
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_row = offsets[:-1][offsets[:-1] < len(data)]
    first[starts_row] = inside[starts_row]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = np.diff(np.append(begin, len(data)))
    place = np.arange(begin[0], len(data)) - np.repeat(begin, span)
    value = (LOWER[data[begin[0] :]].astype(U) + U(1)) * powers(int(span.max()) + 1)[place]
    value[~inside[begin[0] :]] = 0
    row = np.searchsorted(offsets, begin, "right") - 1
    return mix(np.add.reduceat(value, begin - begin[0])), begin - offsets[row], row


def shingles(word: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every run of k words within a row; a row of fewer words has one run of all of them."""
    salt = mix(np.arange(1, k + 1, dtype=U))
    n = len(word)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: max(n - k + 1, 0)] == row[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    h = np.zeros(len(at), U)
    for j in range(k):
        h += word[at + j] * (salt[j] | U(1))
    h = mix(h)
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    many = np.diff(np.append(heads, n))
    short = heads[many < k]
    if len(short):
        lens = many[many < k]
        own = np.zeros(len(short), U)
        for j in range(k - 1):
            has = lens > j
            own[has] += word[short[has] + j] * (salt[j] | U(1))
        own = mix(own + lens.astype(U) * salt[k - 1])
        h, at = np.concatenate([h, own]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, row[at], at


def sets(strings: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each row, by row and then by hash."""
    word, _, row = words(strings)
    h, r, _ = shingles(word, row, k)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
        h, r = h[new], r[new]
    return h, r
