import json
import math

import pytest
from pyspark.sql import functions as F

from weftwork.functions import text
from weftwork.operators import blocking, features, models, translit
from weftwork.sources import files
from weftwork.streaming import records as stream


def recs(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")


def test_tsv_keeps_quotes_and_na(spark, tmp_path):
    rows = [("S2-1", '"""ehpad Club SAS', "NA", "France"), ("S2-2", "null", "", "US"), ("S2-3", "a\rb", "x", "US")]
    path = str(tmp_path / "t")
    files.write_tsv(recs(spark, rows), path)
    assert sorted(tuple(r) for r in files.read_tsv(spark, path).collect()) == sorted(rows)
    (tmp_path / "bad.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\tx\n")
    with pytest.raises(Exception):
        files.read_tsv(spark, str(tmp_path / "bad.tsv")).collect()


def test_id_lists_sort_as_strings(spark):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    pairs = spark.createDataFrame([("S1-1", "S2-9"), ("S1-1", "S2-10"), ("S1-1", "S2-9"), ("S1-9", "S2-1")], "s1_id string, o_id string")
    assert {tuple(r) for r in files.id_lists(ids, pairs).collect()} == {("S1-1", "S2-10,S2-9"), ("S1-2", "")}
    labels = spark.createDataFrame([("S1-1", "a,b"), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    assert {tuple(r) for r in files.truth_pairs(labels).collect()} == {("S1-1", "a"), ("S1-1", "b")}


def test_json_has_no_nan(tmp_path):
    files.write_json({"a": float("nan"), "b": [1, float("inf")], "c": {"d": 2.5}}, str(tmp_path / "x" / "y.json"))
    assert json.loads((tmp_path / "x" / "y.json").read_text()) == {"a": None, "b": [1, None], "c": {"d": 2.5}}


def test_record_keys_and_fallback(spark):
    rows = text.add_clean(recs(spark, [("1", "The Private Limited", "1 Main Street", "US"), ("2", None, None, "US"), ("3", "Acme Dental Inc", "12 Oak Rd", "US")]))
    got = {}
    for r in blocking.record_keys(rows, "entity_id").collect():
        got.setdefault(r["entity_id"], set()).add(r["key"])
    assert {"n|the", "n|pvt", "n|ltd", "a|main", "aa|1_main", "aa|main_st", "a|1"} <= got["1"] and "2" not in got
    assert {"n|acme", "n|dental", "nn|acme_dental", "na|acme@oak", "c|acmedental", "a|12"} <= got["3"] and "n|inc" not in got["3"]


def test_budget_keeps_the_first_and_stops_before_the_limit(spark):
    rows = spark.createDataFrame([("x", "a", 1), ("x", "b", 5), ("x", "c", 9), ("y", "d", 99)], "io string, key string, df int")
    got = {(r["io"], r["key"]) for r in blocking.within_budget(rows, "io", 24, 6).collect()}
    assert got == {("x", "a"), ("x", "b"), ("y", "d")}


def test_records_with_common_keys_only_have_candidates(spark):
    """Against a plain version; with a cap of 3, records 101, 102 and 104 have common keys only."""
    s1 = [(i, "US", k) for i in range(12) for k in ["n|all", "a|even"][: 2 - i % 2]] + [(7, "US", "n|rare"), (3, "FR", "n|all"), *[(i, "US", "a|late") for i in range(6, 12)]]
    o = [(100, "US", "n|rare"), (100, "US", "n|all"), (101, "US", "n|all"), (101, "US", "a|even"), (102, "US", "a|late"), (102, "US", "a|even"), (102, "US", "n|none"), (103, "US", "n|none"), (104, "US", "n|all"), (104, "US", "a|even"), (105, "FR", "n|all")]
    n = {"US": 12, "FR": 4}
    keys = lambda rows, name: spark.createDataFrame(rows, f"{name} int, country string, key string")
    rows = blocking.key_candidates(keys(s1, "i1"), keys(o, "io"), spark.createDataFrame(list(n.items()), "country string, n int"), top_k=3, df_cap=3).collect()
    lists = {}
    for i, c, k in s1:
        lists.setdefault((c, k), set()).add(i)
    want = set()
    for io in {r[0] for r in o}:
        mine = [(c, k) for i, c, k in o if i == io and (c, k) in lists]
        used = [k for k in mine if len(lists[k]) <= 3] or mine
        scores = {i: (round(sum(math.log(n[k[0]] / len(lists[k])) for k in used if i in lists[k]), 9), sum(i in lists[k] for k in used)) for i in {i for k in used for i in lists[k]}}
        want |= {(io, i, *scores[i]) for i in sorted(scores, key=lambda i: (-scores[i][0], i))[:3]}
    assert {r["io"] for r in rows} == {100, 101, 102, 104, 105} and len(rows) == len(want)
    assert {(r["io"], r["i1"], round(r["block_score"], 9), r["n_shared"]) for r in rows} == want


def test_tfidf_against_brute_force(spark):
    s1 = [(1, "US", "acme dental"), (2, "US", "acme motors"), (3, "FR", "acme dental"), (4, "US", "zenith foods")]
    o = [(10, "US", "acme dentol"), (11, "FR", "acme"), (12, "US", ""), (13, "XX", "acme dental")]
    got = {(r["io"], r["i1"]): r["tfidf_sim"] for r in blocking.tfidf_candidates(spark.createDataFrame(s1, "i1 int, country string, text string"), spark.createDataFrame(o, "io int, country string, text string"), max_df=1.0, min_sim=0.1).collect()}

    def grams(t):
        t = f" {t.replace(' ', '_')} "
        return [t[i : i + 3] for i in range(len(t) - 2)]

    def vectors(country):
        texts = [grams(t) for _, c, t in s1 if c == country]
        df = {}
        for g in texts:
            for x in set(g):
                df[x] = df.get(x, 0) + 1
        return {x: math.log((1 + len(texts)) / (1 + n)) + 1 for x, n in df.items()}

    def vec(t, idf):
        v = {}
        for x in grams(t):
            if x in idf:
                v[x] = v.get(x, 0) + 1
        v = {x: (1 + math.log(n)) * idf[x] for x, n in v.items()}
        norm = math.sqrt(sum(y * y for y in v.values())) or 1
        return {x: y / norm for x, y in v.items()}

    want = {}
    for io, c, t in o:
        idf = vectors(c)
        for i1, c1, t1 in s1:
            if c1 == c:
                a, b = vec(t, idf), vec(t1, idf)
                sim = sum(a[x] * b.get(x, 0) for x in a)
                if sim >= 0.1:
                    want[(io, i1)] = sim
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_learned_words(spark):
    s1 = recs(spark, [("S1-1", "Acme Foods", "x, Kerala", "India"), ("S1-2", "Zen Foods", "y, Kerala", "India")])
    o = recs(spark, [("S2-1", "एक्मे फूड्स", "x, केरल", "India"), ("S2-2", "ज़ेन फूड्स", "y, केरल", "India"), ("S2-3", "एक्मे", None, "India")])
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-1", "S2-3")], "s1_id string, o_id string")
    d = translit.learn_words(s1, o, pairs)
    assert {tuple(r) for r in d.collect()} == {("फूड्स", "foods")}
    assert {r["name_lat"] for r in translit.transliterate_names(o, d).collect()} == {"एक्मे foods", "ज़ेन foods", "एक्मे"}
    a = translit.learn_address_parts(s1, o, pairs, min_count=2)
    assert {tuple(r) for r in a.collect()} == {("केरल", "kerala")}
    assert {r["addr_lat"] for r in translit.transliterate_addresses(o, a).collect()} == {"x, kerala", "y, kerala", ""}


def test_number_and_word_features(spark):
    df = spark.createDataFrame(
        [(1, 2, ["6705"], ["6708"], "6705", "6708", "acme", "acme", "", "", "a", "a", "acme", "acme inc"), (3, 4, ["67"], ["6705"], "67", "6705", "", "acme", "ltd", "pvt", "", "b", "", "acme"), (5, 6, [], [], None, None, "", "", "", "", "", "", "", "")],
        "io int, i1 int, nums array<string>, nums_1 array<string>, num0 string, num0_1 string, core string, core_1 string, legal string, legal_1 string, adc string, adc_1 string, nm string, nm_1 string")
    rows = {r["io"]: r for r in features.word_features(features.number_features(df)).collect()}
    assert rows[1]["hn_min_logdiff"] == pytest.approx(math.log(4)) and rows[1]["hn_near"] and not rows[1]["hn0_prefix"] and rows[1]["extra_all_1"] == 1
    assert rows[3]["hn0_prefix"] and rows[3]["legal_conflict"] and rows[3]["addr_missing"] and rows[3]["extra_tok_o"] == 1
    assert rows[5]["hn_min_logdiff"] is None and rows[5]["hn_near"] is False and rows[5]["first_tok_eq"] and rows[5]["core_eq"] and rows[5]["num_jacc"] == 0


def test_competition_small(spark):
    df = spark.createDataFrame([(1, 10, 2, 0.9), (1, 11, 2, 0.4), (2, 10, 3, 0.6), (3, 10, 3, 0.2)], "io int, i1 int, src int, p1 double")
    rows = {(r["io"], r["i1"]): r for r in features.competition(df).collect()}
    r = rows[(1, 10)]
    assert (r["q_rank"], r["q_2nd"], r["q_n"], r["s_n"], r["s_n_best"], r["s_n_strong"]) == (1, 0.4, 2, 3, 3, 2)
    assert rows[(2, 10)]["s_gap"] == pytest.approx(0.3) and rows[(1, 11)]["s_n_best"] == 0 and rows[(1, 11)]["s_max"] == 0


def test_folds_follow_owner_and_anchor(spark):
    pairs = spark.createDataFrame([(io, i1) for io in range(40) for i1 in range(3)], "io long, i1 long")
    owners = spark.createDataFrame([(io, io % 3) for io in range(20)], "io long, i1 long")
    parents = spark.createDataFrame([(io, io % 5) for io in range(40)], "io long, parent long")
    rows = models.labelled_pairs(pairs, owners, parents).collect()
    side = {}
    for r in rows:
        key = r["owner"] if r["owner"] is not None else r["io"] % 5
        assert side.setdefault(key, (r["fold"], r["val"])) == (r["fold"], r["val"])
        assert r["y"] == float(r["owner"] == r["i1"])


def test_out_of_fold_scores_every_row_once(spark):
    rows = spark.range(400).selectExpr("id AS io", "id % 7 AS i1", "cast(id % 2 as double) AS y", "cast(id % 2 + rand(1) as double) AS x", "cast(1 as int) AS rank_combo", "cast(1 as int) AS rank_block", "cast(id % 4 < 2 as int) AS fold").cache()
    scored, unseen = models.out_of_fold(rows, ["x"], learner="logistic", unseen=rows)
    assert scored.count() == 400 and unseen.count() == 400
    got = scored.groupBy("y").agg(F.avg("p1").alias("p")).orderBy("y").collect()
    assert got[0]["p"] < 0.2 and got[1]["p"] > 0.8


def test_stream(spark, tmp_path):
    recs(spark, [("S3-1", "Acme Dental", "1 Main Street", "US")]).write.parquet(str(tmp_path / "in"))
    q = stream.key_stream(stream.record_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("keys").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {"n|acme", "a|main"} <= {r["key"] for r in spark.table("keys").collect()}
