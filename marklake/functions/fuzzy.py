"""Partial fuzzy ratio: the best alignment of the shorter string inside the longer one, 0 to 100.

For strings s and t, |s| <= |t|, it is the largest ``100 * 2 * LCS(s, w) / (|s| + |w|)`` over the windows w of
|s| characters of t and over its shorter prefixes and suffixes.  Spark has no such function (levenshtein is
another distance), so it runs as an Arrow UDF, after cheaper native tests have settled most pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _lcs(places: dict[str, int], n: int, window: str) -> int:
    """Length of the longest common subsequence, by the bits of the pattern's ``places``."""
    full = (1 << n) - 1
    row = full
    for ch in window:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return n - row.bit_count()


def partial_ratio(a: str, b: str) -> float:
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 100.0 if not t else 0.0
    if s in t:
        return 100.0
    n, m = len(s), len(t)
    places: dict[str, int] = {}
    for i, ch in enumerate(s):
        places[ch] = places.get(ch, 0) | 1 << i
    best = 0.0
    for end in sorted(range(1, m + n), key=lambda e: -min(e, m) + max(0, e - n)):  # long windows first: they bound the short ones
        start, stop = max(0, end - n), min(end, m)
        # A window that begins or ends on a character foreign to s is no better than one without it.
        if (stop == end and t[stop - 1] not in places) or (stop < end and t[start] not in places):
            continue
        if 200.0 * min(n, stop - start) / (n + stop - start) <= best:
            continue
        best = max(best, 200.0 * _lcs(places, n, t[start:stop]) / (n + stop - start))
    if n == m:
        back: dict[str, int] = {}
        for i, ch in enumerate(t):
            back[ch] = back.get(ch, 0) | 1 << i
        for end in range(1, 2 * n):
            w = s[max(0, end - n) : end]
            best = max(best, 200.0 * _lcs(back, n, w) / (n + len(w)))
    return best


def _one(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


partial_ratio_udf = F.pandas_udf(_one, DoubleType())
