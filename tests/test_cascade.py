"""What must hold of the cascade over every pair."""

import os

import pytest

from weftwork.plans import cascade, er
from weftwork.plans.relational import others, scored_pairs

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def test_filter_scores_every_pair_of_a_record(spark):
    got = cascade.REG.queries["ml4_filter_all_pairs"](spark, DATA)
    pairs = scored_pairs(spark, DATA).join(others(spark, DATA), "io", "left_semi").select("io", "i1")
    assert got.count() == got.select("io", "i1").distinct().count() == pairs.count()
    assert pairs.join(got, ["io", "i1"], "left_anti").count() == 0
    truth = er.truth(spark, DATA).select(er.number("s1_id").alias("i1"), er.number("o_id").alias("io"))
    right, other = got.join(truth, ["io", "i1"], "left_semi"), got.join(truth, ["io", "i1"], "left_anti")
    assert right.filter("p1 > 0.5").count() > 0.8 * right.count() and other.filter("p1 > 0.5").count() < 0.5 * other.count()


def test_text_pairs_by_both_ranks(spark, tmp_path):
    pairs = [(1, 10, 9.0, 0.1), (1, 11, 8.0, 0.2), (1, 12, 7.0, 0.3), (1, 13, 6.0, 0.9), (1, 14, 5.0, 0.8), (1, 15, 4.0, 0.0), (2, 10, 1.0, 0.0), (3, 11, 1.0, 0.0)]
    spark.createDataFrame([(*x[:3], 1, x[3], 0.5) for x in pairs], "io long, i1 long, block_score double, n_shared int, tfidf_sim double, p double").write.parquet(str(tmp_path / "candidate_pairs.parquet"))
    spark.createDataFrame([("S1-11", "S2-1"), ("S1-99", "S3-2")], "source1_entity_id string, matched_entity_ids string").write.parquet(str(tmp_path / "match_labels.parquet"))
    rows = cascade.REG.queries["ml10_text_pair_folds_with_fold"](spark, str(tmp_path)).collect()
    assert {(r["io"], r["i1"], r["y"], r["hardest"]) for r in rows} == {(1, 10, 0.0, True), (1, 11, 1.0, False), (1, 12, 0.0, False), (1, 13, 0.0, True), (1, 14, 0.0, False), (2, 10, 0.0, True), (2, 99, 1.0, False), (3, 11, 0.0, True)}
    folds = {}
    for r in rows:
        folds.setdefault(r["io"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in folds.values()) and folds[1] == folds[3]  # the owner of 1 is the top candidate of 3


def test_text_pairs_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("candidate_pairs", "match_labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = sorted(con.execute(cascade.REG.sql["ml10_text_pair_folds_both_ranks"]).fetchall())
    assert sorted(tuple(r) for r in cascade.REG.queries["ml10_text_pair_folds_both_ranks"](spark, DATA).select("io", "i1", "y", "hardest").collect()) == want
