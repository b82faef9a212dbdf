"""Queries over every pair and record, names in any script, against plain versions on small tables."""

import itertools

import pytest
import regex

from weftwork.plans import er

S1 = [("S1-1", "Acme Foods", "12 Main Street, Springfield", "US"), ("S1-2", "Café Münster", "5 Rue de la Paix, Paris", "France"), ("S1-3", "एक्मे फूड्स", "9 MG Road, Kerala", "India")]
S2 = [("S2-10", "ACME FOODS INC", "12 MAIN ST, SPRINGFIELD", "US"), ("S2-11", "CAFE MUNSTER", None, "France"), ("S2-12", None, "9 MG ROAD", "India"), ("S2-13", "Zed dba Acme", "NA", "US")]
S3 = [("S3-20", "Ａｃｍｅ Fооds", "12 Main Str", "US"), ("S3-21", "Cafè Münster SARL", "5 rue de la paix", "France"), ("S3-22", "एकमे फूड", "9 MG Road", "India"), ("S3-23", "𝒜cme 😀 Foods", "", "US"), ("S3-24", "फूड्सaka Zen", "1 A Road", "India"), ("S3-25", "Été aka Zen", "1 A Road", "France"), ("S3-26", "akaé Zen.inç", "1 A Road", "France"), ("S3-27", "Zén.in", "1 A Road", "France"), ("S3-28", "#एक्मे", "1 A Road", "India")]
NAMES = {r[0]: r[1] for r in S1 + S2 + S3}


def number(entity_id):
    return int(entity_id.split("-")[1])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    schema = "entity_id string, business_name string, business_address string, country string"
    for name, rows in (("source1", S1), ("source2", S2 + S2[:1]), ("source3", S3)):
        spark.createDataFrame(rows, schema).write.parquet(str(d / f"{name}.parquet"))
    pairs = [(number(o[0]), number(r[0]), 1.0, 1, 0.5, 0.5) for o, r in itertools.product(S2 + S3, S1)]
    spark.createDataFrame(pairs, "io long, i1 long, block_score double, n_shared int, tfidf_sim double, p double").write.parquet(str(d / "candidate_pairs.parquet"))
    return str(d)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def winkler(a, b):
    """Jaro-Winkler from its definition, with the places of the common letters."""
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, pairs = set(), []
    for i, x in enumerate(a):
        j = next((j for j, y in enumerate(b) if y == x and abs(i - j) <= reach and j not in used), None)
        if j is not None:
            used.add(j)
            pairs.append((i, j))
    if not pairs:
        return float(a == b)
    m, order = len(pairs), sorted(j for _, j in pairs)
    t = sum(b[j] != a[i] for (i, _), j in zip(pairs, order)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a[:4], b[:4]))))
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_similarities_of_every_pair(spark, tables):
    want = {(number(o[0]), number(r[0])): (o[1] or "", r[1]) for o, r in itertools.product(S2 + S3, S1)}
    got = {(r["io"], r["i1"]): r["jw"] for r in er.REG.queries["sm5_jaro_winkler_all_scripts"](spark, tables).collect()}
    assert got == {k: pytest.approx(winkler(*v), abs=1e-6) for k, v in want.items()}
    got = {(r["io"], r["i1"]): r["edits"] for r in er.REG.queries["sm6_levenshtein_all_scripts"](spark, tables).collect()}
    assert got == {k: edits(*v) for k, v in want.items()}


def test_flags_of_every_record(spark, tables):
    rows = er.REG.queries["tx6_flags_all_scripts"](spark, tables).collect()
    assert len(rows) == len(NAMES)
    for r in rows:
        name = NAMES[r["entity_id"]] or ""
        assert r["indic"] == any("\u0900" <= c <= "\u0dff" for c in name), name
        assert r["webname"] == bool(regex.search(r"(?i)\.com|\.in(?![\w\p{M}])|^[#@]", name)), name
        assert r["alias"] == bool(regex.search(r"(?i)(?<![\w\p{M}])(?:dba|fka|aka|a/k/a|d/b/a|f/k/a)(?![\w\p{M}])", name)), name
    assert {r["entity_id"] for r in rows if r["alias"]} == {"S2-13", "S3-25"} and {r["entity_id"] for r in rows if r["webname"]} == {"S3-27", "S3-28"}


def by_id(spark, tables, name, col):
    rows = er.REG.queries[name](spark, tables).collect()
    assert {r["entity_id"] for r in rows} == set(NAMES)
    if name != "bk1_record_keys_all_records":
        assert len(rows) == len(NAMES)
    return {r["entity_id"]: r[col] for r in rows}


def test_cleaning_of_every_record(spark, tables):
    tokens = by_id(spark, tables, "tx4_name_tokens_all_records", "tokens")
    assert tokens["S2-10"] == "acme foods inc" and tokens["S2-12"] == "" and tokens["S3-21"] == "cafe munster sarl" and tokens["S1-1"] == "acme foods"
    address = by_id(spark, tables, "tx5_address_tokens_all_records", "tokens")
    assert address["S2-10"] == address["S1-1"] == "12 main st springfield" and address["S2-11"] == "" == address["S3-23"]
    core = by_id(spark, tables, "tx6_prepare_all_records", "core")
    assert core["S2-10"] == core["S1-1"] == "acme foods" and core["S2-12"] == "" and core["S3-21"] == "cafe munster"
    assert by_id(spark, tables, "tx8_script_words_all_records", "words")["S3-22"] == "एकमे|फूड"
    texts = by_id(spark, tables, "tx10_model_text_all_records", "t")
    assert texts["S2-12"] == " | 9 MG ROAD" and texts["S3-22"].startswith("एकमे फूड / ") and texts["S2-11"] == "CAFE MUNSTER | "
    assert by_id(spark, tables, "tx11_street_key_all_records", "street")["S2-10"] == by_id(spark, tables, "tx6_prepare_all_records", "adc")["S2-10"].replace("12", "")


def test_keys_and_candidates_from_records(spark, tables):
    keys = {}
    for r in er.REG.queries["bk1_record_keys_all_records"](spark, tables).collect():
        keys.setdefault((r["entity_id"], r["country"]), set()).add(r["key"])
    assert {i for i, _ in keys} == set(NAMES)
    assert {"n|acme", "nn|acme_foods", "na|acme@main", "c|acmefoods", "a|springfield", "aa|12_main"} <= keys["S2-10", "US"] and "n|inc" not in keys["S2-10", "US"]
    country = {r[0]: r[3] for r in S1 + S2 + S3}
    want = {}
    for o, r in itertools.product(S2 + S3, S1):
        if country[o[0]] == country[r[0]]:
            both = keys[o[0], o[3]] & keys[r[0], r[3]]
            if both:
                want[number(o[0]), number(r[0])] = len(both)
    got = {(r["io"], r["i1"]): r["n_shared"] for r in er.REG.queries["bk5_generate_candidates"](spark, tables).collect()}
    assert (20, 1) in want and (22, 3) in want and got.keys() == want.keys() and all(n == min(want[k], 24) for k, n in got.items())
