"""Registered queries against their SQL, and the same result whatever the number of shuffle partitions."""

import math
import os

import pytest

from weftwork.plans import catalog

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")

CHECKED = ["p5_found", "jn2_inverted_index", "jn5_full_outer_merge", "ag5_median_percentiles", "wn9_conditional", "st4_array_sets", "tx6_prepare", "bk1_record_keys", "bk5_rounded_candidates", "ft_competition", "de2_threshold_sweep", "de7_evaluate", "dg18_ranked_auc", "so8_permutation", "ml2_decoys_follow_anchor", "de5_matches_within_candidates", "dg2_measures", "dg3_entity_ranking", "ml6_prune_settings", "dg12_density_correction", "tl3_transliterate_names"]


def queries():
    return {n: f for r in catalog.registries() for n, f in r.queries.items()}


def oracles():
    return {n: s for r in catalog.registries() for n, s in r.sql.items()}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, sql, name):
    cur = sql.execute(oracles()[name])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
    df = queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df) == want


def test_inverted_index_over_all_keys(spark, tmp_path):
    """A key in 30 reference records, beyond the 20 of jn2_inverted_index, pairs its records all the same."""
    rows = [(i, 1, "US", "n|all") for i in range(30)] + [(3, 1, "US", "a|few"), (3, 1, "US", "a|few"), (4, 1, "FR", "n|all"), (100, 2, "US", "n|all"), (100, 2, "US", "a|few"), (101, 3, "US", "n|all"), (102, 3, "FR", "n|all"), (103, 3, "US", None)]
    spark.createDataFrame(rows, "id long, src byte, country string, key string").write.parquet(str(tmp_path / "blocking_keys.parquet"))
    got = {(r["src"], r["io"], r["i1"]): r["n_shared"] for r in queries()["jn2_all_keys"](spark, str(tmp_path)).collect()}
    assert got == {(s, io, i): 1 + (io == 100 and i == 3) for s, io in ((2, 100), (3, 101)) for i in range(30)} | {(3, 102, 4): 1}


@pytest.mark.parametrize("name", ["p5_key_counts", "bk5_rounded_candidates", "ft_competition", "ag10_first_per_group"])
def test_does_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in (1, 8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append(rows_of(queries()[name](spark, DATA)))
        assert got[0] == got[1] == got[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_oracle_has_its_query():
    assert set(oracles()) <= set(queries())
    assert catalog.flagship is not None


def test_inverted_index_equals_sql(spark, sql):
    want = sorted(tuple(r) for r in sql.execute(oracles()["jn2_all_keys"]).fetchall())
    assert sorted(tuple(r) for r in queries()["jn2_all_keys"](spark, DATA).select("src", "io", "i1", "n_shared").collect()) == want
