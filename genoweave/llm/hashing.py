"""Word and shingle hashes with numpy, and Bloom filters built by Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M = 0x9E3779B97F4A7C15
_POWERS = _INVERSES = np.ones(1, "uint64")
#: Bytes of a text up to which the powers reach over all of it.
_SPAN = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word ([^\\x20\\x09-\\x0D]+), A-Z lower-cased, in order."""
    return words_and_lines(text)[0]


def words_and_lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and for each line (between \\n) the number of words before its end."""
    if not text:
        return np.zeros(0, "uint64"), np.zeros(1, "int64")
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), "u1")  # bytes.lower() changes A-Z only
    space = np.ones(len(data) + 2, bool)
    np.take(_SPACE, data, out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, stops = edges[::2], edges[1::2]
    ends = np.append(np.searchsorted(starts, np.flatnonzero(data == 10)), len(starts))
    return mix(_sums(data, starts, stops)), ends


def _sums(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sum of (byte + 1) * _M ** place over each word, place counted in the word."""
    global _POWERS, _INVERSES
    most = len(data) if len(data) <= _SPAN else int((stops - starts).max(initial=0))
    if most > len(_POWERS):
        _POWERS, _INVERSES = (np.multiply.accumulate(np.where(np.arange(2 * most) == 0, np.uint64(1), np.uint64(b))) for b in (_M, pow(_M, -1, 1 << 64)))
    if len(data) <= _SPAN:  # differences of a running sum, with powers counted from the beginning and taken back
        run = np.zeros(len(data) + 1, "uint64")
        np.cumsum((data.astype("uint64") + np.uint64(1)) * _POWERS[: len(data)], out=run[1:])
        return (run[stops] - run[starts]) * _INVERSES[starts]
    out = np.zeros(len(starts), "uint64")  # the table of powers need not be as long as a very long text
    for lo in range(0, len(starts), _SPAN):
        a, b = starts[lo : lo + _SPAN], stops[lo : lo + _SPAN]
        size = b - a
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        own = data[np.repeat(a, size) + place].astype("uint64") + np.uint64(1)
        out[lo : lo + _SPAN] = np.add.reduceat(own * _POWERS[place], first)
    return out


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` values, in order."""
    n = len(h) - width + 1
    out = np.zeros(max(0, n), "uint64")
    for i in range(width if n > 0 else 0):
        out = out * np.uint64(_M) + h[i : i + n]
    return mix(out)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; with fewer words the whole sequence as one; without words empty."""
    h = word_hashes(text)
    return np.unique(windows(h, min(width, len(h)))) if len(h) else h


def bloom(keys: DataFrame, column: str, bits_a_key: int = 16, most_bits: int = 1 << 28) -> tuple[np.ndarray, int]:
    """Bloom filter (two probes) of a column of 64-bit hashes: its words, and the number of bits (a power of two).

    Bits are set by bit_or in Spark. At most most_bits, so its size is bounded; beyond that it lets more through.
    """
    n = max(1, keys.count())
    bits = min(most_bits, 1 << max(12, (n * bits_a_key - 1).bit_length()))
    at = [F.col(column).bitwiseAND(bits - 1), F.shiftrightunsigned(column, 32).bitwiseAND(bits - 1)]
    spots = keys.select(F.explode(F.array(*at)).alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 63 as int))")
    # By Arrow: as Python rows, a million words would take hundreds of MB.
    found = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
    words = np.zeros(bits >> 6, "int64")
    words[found["w"].to_numpy()] = found["v"].to_numpy()
    return words.view("uint64"), bits


def in_bloom(words: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for p in (h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)):
        out &= (words[(p >> np.uint64(6)).astype("int64")] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view("int64")


def id_hash(column: str) -> Column:
    return F.xxhash64(column)
