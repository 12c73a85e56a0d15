"""Similarities of strings and sets: column expressions for sets, Arrow-batched UDFs for edit-based ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def share(part: str, whole: str) -> Column:
    """Part over whole, of counts; 0 without any."""
    return _share(F.col(part), F.col(whole))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if both are empty."""
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Shared over the smaller set's elements; 0 if it is empty."""
    return _share(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer length; 0 if either is empty."""
    return _share(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, a row of the table at a time in the bits of one number."""
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (both lengths), 1 for two empty strings."""
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


def jaro_winkler_of(a, b) -> float:
    """Jaro-Winkler similarity of two sequences (characters or bytes), with the prefix bonus above 0.7 only."""
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    free = (1 << n) - 1
    window = (1 << reach + 1) - 1  # places of a within reach of place j of b
    taken, order = 0, []
    for j, c in enumerate(b):
        if c in where:
            found = where[c] & free & window
            if found:
                low = found & -found
                free ^= low
                taken |= low
                order.append(c)
        window = window << 1 | (1 if j + 1 <= reach else 0)
    same = len(order)
    if not same:
        return 0.0
    swapped, i = 0, 0
    while taken:
        low = taken & -taken
        swapped += a[low.bit_length() - 1] != order[i]
        taken ^= low
        i += 1
    jaro = (same / n + same / m + (same - swapped // 2) / same) / 3
    if jaro > 0.7:
        prefix = 0
        while prefix < min(4, n, m) and a[prefix] == b[prefix]:
            prefix += 1
        jaro += prefix * 0.1 * (1 - jaro)
    return jaro


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """1 if one word set holds the other (and shares a word), else the best of three ratios of shared and differing words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not only_a or not only_b):
        return 1.0
    left, right = f"{shared} {only_a}".strip(), f"{shared} {only_b}".strip()
    best = indel_ratio(left, right)
    if shared:
        best = max(best, indel_ratio(shared, left), indel_ratio(shared, right))
    return best


def _pairwise(function: Callable[[str, str], float]):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = {}  # near copies share names, so that a batch holds few pairs of them

        def of(x, y):
            if (x, y) not in known:
                known[x, y] = None if x is None or y is None else function(x, y)
            return known[x, y]

        return pd.Series([of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return pandas_udf(run, DoubleType())


jaro_winkler = _pairwise(jaro_winkler_of)
"""By code points."""


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in rows of equal width, and their lengths."""
    size = np.array([len(x) for x in texts], np.int64)
    width = max(int(size.max()), 4)
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(len(texts), width), size


def _matched(chars: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The taken characters of each row, moved to its left end."""
    out = np.zeros(chars.shape, np.uint8)
    rows, at = np.nonzero(taken)
    out[rows, (np.cumsum(taken, axis=1) - 1)[rows, at]] = chars[rows, at]
    return out


def jaro_winkler_of_many(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """``jaro_winkler_of`` for each pair of 1 to 64 bytes: a step works on one place of all pairs."""
    (x, n), (y, m) = _padded(a), _padded(b)
    one, full = np.uint64(1), ~np.uint64(0)
    wide = np.zeros((len(a), 64), np.uint8)
    wide[:, : x.shape[1]] = x
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    free, used = full >> (64 - n).astype(np.uint64), np.zeros(y.shape, bool)
    for j in range(int(m.max())):
        low, high = np.minimum(np.maximum(j - reach, 0), 63), np.minimum(j + reach, 63)  # places of a within reach
        window = (full >> (63 - high).astype(np.uint64)) & (full << low.astype(np.uint64))
        equal = np.packbits(wide == y[:, j, None], axis=1, bitorder="little").view("<u8")[:, 0]
        found = np.where((j < m) & (j - reach < 64), equal & free & window, np.uint64(0))
        free ^= found & (~found + one)
        used[:, j] = found != 0
    left = np.unpackbits(free.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : x.shape[1]] != 0
    taken = (np.arange(x.shape[1]) < n[:, None]) & ~left
    same = used.sum(axis=1)
    width = min(x.shape[1], y.shape[1])
    swapped = (_matched(x, taken)[:, :width] != _matched(y, used)[:, :width]).sum(axis=1)
    some = np.maximum(same, 1)
    jaro = np.where(same > 0, (same / n + same / m + (same - swapped // 2) / some) / 3, 0.0)
    alike = np.logical_and.accumulate((x[:, :4] == y[:, :4]) & (np.arange(4) < np.minimum(n, m)[:, None]), axis=1)
    return np.where(jaro > 0.7, jaro + alike.sum(axis=1) * 0.1 * (1 - jaro), jaro)


def jaro_winkler_of_bytes(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """``jaro_winkler_of`` for each pair, 0 for two empty ones."""
    out = np.zeros(len(a))
    short = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if 1 <= len(x) <= 64 and 1 <= len(y) <= 64]
    if short:
        out[short] = jaro_winkler_of_many([a[i] for i in short], [b[i] for i in short])
    for i in set(range(len(a))) - set(short):
        out[i] = jaro_winkler_of(a[i], b[i]) if a[i] or b[i] else 0.0
    return out


@pandas_udf(DoubleType())
def jaro_winkler_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    """By UTF-8 bytes, as some SQL engines do; 0 for two empty strings."""
    known = dict.fromkeys(zip(a, b, strict=True))  # near copies share names, so that a batch may hold few pairs of them
    whole = [p for p in known if p[0] is not None and p[1] is not None]
    known.update(zip(whole, jaro_winkler_of_bytes(*([p[i].encode() for p in whole] for i in (0, 1))).tolist(), strict=True))
    return pd.Series([known[p] for p in zip(a, b, strict=True)], dtype="float64")


ratio = _pairwise(indel_ratio)
sorted_ratio = _pairwise(token_sort_ratio)
set_ratio = _pairwise(token_set_ratio)
