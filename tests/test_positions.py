import random
from collections import defaultdict

from weftwork.operators.positions import distinct_by_key, with_positions
from weftwork.plans.skew import frequent_keys


def skewed(n=3000, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = None if rng.random() < 0.02 else "hot" if rng.random() < 0.4 else f"k{rng.randrange(200)}"
        rows.append((rng.choice(["US", "FR", None]), key, rng.choice([1, 2, None]), rng.randrange(n // 4)))
    return rows + rows[:200]


def test_positions_match_brute_force_and_do_not_depend_on_width(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "country string, key string, src int, id long")
    want = defaultdict(list)
    for r in rows:
        want[r[:2]].append(r[3])
    for width in (1, 3, 17):
        got = defaultdict(list)
        for r in with_positions(df, ["country", "key"], ["id"], width=width).collect():
            got[(r["country"], r["key"])].append((r["position"], r["id"]))
        assert got.keys() == want.keys()
        for k, ids in want.items():
            assert sorted(got[k]) == list(enumerate(sorted(ids), 1))


def test_keep_and_clashing_column(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 4, "y"), (2, 9, "z")], "g int, v int, position string")
    got = with_positions(df, ["g"], ["v"], keep=1).collect()
    assert sorted((r["g"], r["v"], r["position"]) for r in got) == [(1, 4, 1), (2, 9, 1)]


def test_distinct_by_key_with_hot_key_and_tiny_chunks(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "country string, key string, src int, id long")
    want = defaultdict(list)
    for r in rows:
        want[r[:2]].append(r[2:])
    for chunk, width in ((7, 5), (10**6, 11), (1, 2)):
        got = {(r["country"], r["key"]): (r["n_rows"], r["n_distinct"]) for r in distinct_by_key(df, ["country", "key"], ["src", "id"], chunk, width).collect()}
        assert got == {k: (len(v), len(set(v))) for k, v in want.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "country string, key string, src int, id long")
    assert with_positions(df, ["key"], ["id"]).count() == 0
    assert frequent_keys(df).count() == 0
