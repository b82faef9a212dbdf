import random

import pytest

from weftwork.functions import similarity as s


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_common_subsequence_by_dynamic_programming():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choices("abcé ", k=rng.randrange(0, 30))) for _ in "ab")
        assert s.common_subsequence(a, b) == lcs(a, b)


def test_partial_ratio_against_every_window():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(1, 12))) for _ in "ab")
        x, y = sorted((a, b), key=len)
        n, m = len(x), len(y)
        windows = [y[max(0, i) : min(m, i + n)] for i in range(1 - n, m)]
        assert s.partial_ratio(a, b) == pytest.approx(max(s.ratio(x, w) for w in windows))


def test_partial_ratios_side_by_side():
    rng = random.Random(6)
    pairs = [tuple("".join(rng.choices("abcdé ", k=rng.randrange(0, k))) for _ in "ab") for k in [3, 9, 30, 70, 90] for _ in range(60)]
    assert s.partial_ratios(pairs, 500) == pytest.approx([s.partial_ratio(*p) for p in pairs])
    assert len(s.partial_ratios([])) == 0


def test_conventions():
    assert s.ratio("", "") == 100 and s.ratio("", "a") == 0 and s.ratio("abc", "abc") == 100
    assert s.token_set_ratio("", "") == 0 and s.token_set_ratio("a b", "b a c") == 100
    assert s.token_sort_ratio("new york", "york new") == 100
    assert s.partial_ratio("", "abc") == 0 and s.partial_ratio("abc", "xxabcxx") == 100
    assert s.jaro_winkler("", "") == 1 and s.jaro_winkler("a", "") == 0
    assert s.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert s.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
