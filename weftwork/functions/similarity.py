"""String similarities as Arrow functions; scores of 0 to 100, Jaro-Winkler of 0 to 1.

Two empty texts are alike (100, or 1.0), except for the token-set and partial scores, where an empty side scores 0. Null counts as empty.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _places(text: str) -> dict[str, int]:
    """For each letter the places where it stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def _common(a: str, n: int, places: dict[str, int]) -> int:
    """Length of the longest common subsequence of ``a`` and the text of ``n`` letters with these places, a machine word at a time."""
    row = full = (1 << n) - 1
    for c in a:
        hit = row & places.get(c, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; what both begin or end with belongs to it."""
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < end - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[start : len(a) - tail], b[start : len(b) - tail]
    if len(x) > len(y):
        x, y = y, x
    return start + tail + (_common(x, len(y), _places(y)) if x else 0)


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / n if n else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio of the shared words, and of these with the rest of either side, all in order."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    if not both:
        return ratio(only_x, only_y)
    # all three begin with the shared words
    n, left, right = len(both), len(both) + 1 + len(only_x), len(both) + 1 + len(only_y)
    return max(200.0 * (n + 1 + common_subsequence(only_x, only_y)) / (left + right), 200.0 * n / (n + left), 200.0 * n / (n + right))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text to a window of the longer one; windows at its ends may be shorter. A window is only compared if it could
    be better than the best so far: it has no more in common with the text than letters, and no more than one letter
    a step beyond what the last compared window had."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if a in b:
        return 100.0
    n, m = len(a), len(b)
    left = Counter(a)
    shared, letters = 0, [0] * (m + n)
    for end in range(1, m + n):  # the window b[end - n : end], cut at the ends of b
        if end <= m:
            c = b[end - 1]
            if c in left:
                shared += left[c] > 0
                left[c] -= 1
        if end > n:
            c = b[end - n - 1]
            if c in left:
                left[c] += 1
                shared -= left[c] > 0
        letters[end] = shared
    size = lambda end: n + min(end, m) - max(0, end - n)
    places = _places(a)
    first = max(range(1, m + n), key=lambda end: letters[end] / size(end))
    best = 2.0 * _common(b[max(0, first - n) : first], n, places) / size(first)
    most = n
    for end in range(1, m + n):
        most += 1
        length = n + min(end, m) - max(0, end - n)
        if min(most, letters[end]) * 2.0 > best * length:
            most = _common(b[max(0, end - n) : end], n, places)
            best = max(best, 2.0 * most / length)
    return 100.0 * best


def partial_ratios(pairs: list[tuple[str, str]], most_windows: int = 400_000) -> np.ndarray:
    """``partial_ratio`` of every pair. All windows of all pairs whose shorter text has the same length go side by side through the letters of
    the window, the common subsequence of each held in one machine word; texts of over 64 letters go one by one."""
    out = np.zeros(len(pairs))
    by_length: dict[int, list[tuple[int, str, str]]] = {}
    for i, (a, b) in enumerate(pairs):
        a, b = (b, a) if len(a) > len(b) else (a, b)
        if not a:
            continue
        if a in b:
            out[i] = 100.0
        elif len(a) > 64:
            out[i] = partial_ratio(a, b)
        else:
            by_length.setdefault(len(a), []).append((i, a, b))
    for n, group in by_length.items():
        at = 0
        while at < len(group):
            masks: list[int] = []
            starts, sizes, owners, firsts = [], [], [], []
            windows = 0
            while at < len(group) and windows < most_windows:
                i, a, b = group[at]
                at += 1
                m, places = len(b), _places(a)
                base = len(masks)
                # blank letters before and behind the longer text make windows at its ends whole
                masks += [0] * (n - 1)
                masks += [places.get(c, 0) for c in b]
                masks += [0] * (n - 1)
                firsts.append(windows)
                owners.append(i)
                starts.append(np.arange(base, base + m + n - 1))
                end = np.arange(1, m + n)
                sizes.append(np.minimum(end, m) - np.maximum(end - n, 0))
                windows += m + n - 1
            letters, start = np.array(masks, dtype=np.uint64), np.concatenate(starts)
            full = np.uint64((1 << n) - 1)
            row = np.full(windows, full, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for t in range(n):
                    hit = row & letters[start + t]
                    row = (row + hit) | (row - hit)
            common = n - np.bitwise_count(row & full).astype(np.int64)
            out[owners] = np.maximum.reduceat(200.0 * common / (n + np.concatenate(sizes)), firsts)
    return out


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken_a, taken_b = [False] * len(a), [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken_b[j] and b[j] == c:
                taken_a[i] = taken_b[j] = True
                break
    x = [c for c, t in zip(a, taken_a) if t]
    y = [c for c, t in zip(b, taken_b) if t]
    m = len(x)
    if not m:
        return 0.0
    half = sum(p != q for p, q in zip(x, y)) // 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for p, q in zip(a[:4], b[:4]):
        if p != q:
            break
        prefix += 1
    return jaro + prefix * prefix_weight * (1 - jaro) if jaro > 0.7 else jaro


def _arrow(score):
    @F.pandas_udf(T.DoubleType())
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna("")):
            value = memo.get(pair)
            if value is None:
                value = memo[pair] = score(*pair)
            out.append(value)
        return pd.Series(out, dtype="float64")

    return apply


ratio_of, token_sort_of, token_set_of, partial_of, jaro_winkler_of = map(_arrow, (ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler))


#: The scores of names, cores and addresses that one pass gives, in order.
NAME_SCORES = {"nm_ratio": ratio, "nm_tset": token_set_ratio}
CORE_SCORES = {"core_tsort": token_sort_ratio, "core_tset": token_set_ratio, "core_partial": partial_ratio, "core_jw": jaro_winkler}
JOINED_SCORES = {"concat_ratio": ratio, "concat_partial": partial_ratio}
ADDRESS_SCORES = {"ad_tset": token_set_ratio, "ad_tsort": token_sort_ratio, "ad_partial": partial_ratio}
ALL_SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in (*NAME_SCORES, *CORE_SCORES, *JOINED_SCORES, *ADDRESS_SCORES)])


@F.pandas_udf(ALL_SCORES)
def all_scores_of(nm: pd.Series, nm_1: pd.Series, core: pd.Series, core_1: pd.Series, adc: pd.Series, adc_1: pd.Series) -> pd.DataFrame:
    """All scores of a pair in one pass; each different pair of texts of a batch is scored once."""

    def scored(a: pd.Series, b: pd.Series, scores: dict, squeeze: bool = False) -> np.ndarray:
        at: dict[tuple[str, str], int] = {}
        rows = [at.setdefault(pair, len(at)) for pair in zip(a.fillna(""), b.fillna(""))]
        pairs = [tuple(t.replace(" ", "") for t in p) if squeeze else p for p in at]
        columns = [partial_ratios(pairs) if f is partial_ratio else np.array([f(x, y) for x, y in pairs], dtype=float) for f in scores.values()]
        return np.column_stack(columns)[rows] if rows else np.zeros((0, len(scores)))

    parts = scored(nm, nm_1, NAME_SCORES), scored(core, core_1, CORE_SCORES), scored(core, core_1, JOINED_SCORES, True), scored(adc, adc_1, ADDRESS_SCORES)
    return pd.DataFrame(np.hstack(parts), columns=ALL_SCORES.names)
