"""Pairs are met in cells: what is shuffled is records, and no pair that should come out is lost."""

import random

import pytest

from weftwork.llm import variants


def shuffled(spark, work) -> int:
    """Rows that ``work`` writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages(begin):
        missing = 0
        while missing < 20:
            try:
                yield begin, store.lastStageAttempt(begin).shuffleWriteRecords()
                missing = 0
            except Exception:
                missing += 1
            begin += 1

    spark.range(2).repartition(2).count()
    mark = max([i for i, _ in stages(0)], default=-1)
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for i, n in stages(mark + 1))


def words(seed, letters, n, size):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(size)) for _ in range(n)})


def test_names_that_meet_by_chance_are_not_shuffled(spark):
    """400 x 400 names of one beginning share buckets; before, each such pair was a row of three shuffles."""
    schema = "entity_id string, business_name string, country string"
    s1 = spark.createDataFrame([(f"S1-{i}", "abcdefghijkl" + w, "US") for i, w in enumerate(words(1, "mnopqr", 400, 12))] + [("S1-900", "zenithal foods", "US")], schema)
    s3 = spark.createDataFrame([(f"S3-{i}", "abcdefghijkl" + w, "US") for i, w in enumerate(words(2, "stuvwx", 400, 12))] + [("S3-900", "zenithol foods", "US")], schema)
    links = []
    assert shuffled(spark, lambda: links.extend(variants.link_names(s1, s3, {})[1].collect())) < 40_000
    assert {r["name"] for r in links} == {"zenithol foods"}


def test_could_be_loses_no_name():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)

    def typed(ws):
        out = [list(w) for w in ws]
        for _ in range(rng.randrange(5)):
            w = rng.choice(out)
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "q", "xz", "k"])
        if rng.random() < 0.3:
            rng.shuffle(out)
        if rng.random() < 0.2:
            out[rng.randrange(len(out))] = list(rng.choice(["y", "uvw", "ghtrwq"]))
        return ["".join(w) for w in out if w] or ["x"]

    names = [[w for w in ("".join(rng.choice("aeioumnrst") for _ in range(rng.randrange(1, 10))) for _ in range(rng.randrange(1, 4)))] for _ in range(3000)]
    others = [typed(ws) for ws in names]
    trade = [rng.choice(["", "dental", "foods"]) for _ in names]
    for k, ws in enumerate(others):
        if rng.random() < 0.2:
            others[k] = ["".join(ws) + rng.choice([trade[k], trade[k][:3], "fds"])]
    table = lambda ws, ts: pa.table({"id": list(range(len(ws))), "key": ["".join(w) for w in ws], "words": [" ".join(w) for w in ws], "trade": ts})
    mine = [rng.choice(["", t]) for t in trade]
    a, b = variants.Side(table(others, mine)), variants.Side(table(names, trade))
    at = np.arange(len(names))
    got = variants.could_be(a, at, b, at)
    like = np.array([variants.likeness("".join(x), " ".join(x), t, "".join(y), " ".join(y), u) for x, t, y, u in zip(others, mine, names, trade)])
    assert 500 < (like >= variants.ACCEPT).sum() < 2800
    assert got[like >= variants.ACCEPT].all()
    mixed = np.roll(at, 1)
    assert variants.could_be(a, at, b, mixed).mean() < 0.3


def test_text_candidates_shuffle_records_only(spark):
    """300 texts beside 300 that share trigrams; before, each such pair was a row of a shuffle. Equal texts come by their ids."""
    from weftwork.operators import blocking

    names = words(3, "abcdef", 300, 9)
    s1 = spark.createDataFrame([(2 * i + k, "US", w) for i, w in enumerate(names) for k in (1, 0)], "i1 int, country string, text string")
    o = spark.createDataFrame([(f"o{i}", "US", w) for i, w in enumerate(names)], "io string, country string, text string")
    out = []
    assert shuffled(spark, lambda: out.extend(blocking.tfidf_candidates(s1, o, top_n=2, max_df=1.0, min_sim=0.5).collect())) < 15_000
    best = {}
    for r in out:
        best.setdefault(r["io"], []).append((-r["tfidf_sim"], r["i1"]))
    assert {io: [i for _, i in sorted(x)] for io, x in best.items()} == {f"o{i}": [2 * i, 2 * i + 1] for i in range(len(names))}


@pytest.mark.parametrize("block", [3, 50])
def test_cells_of_many_blocks_and_parts(spark, block):
    """Every asking row beside every reference row of its zone once, however they are dealt; a null zone meets none."""
    import pyarrow as pa

    from weftwork.operators.cells import beside

    rows = lambda n: spark.createDataFrame([(z, i) for z in ("a", "b", None) for i in range(n)], "zone string, id long")

    def answer(ids, batch):
        for x in batch.column("id").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(ids), pa.int64()), pa.array(ids, pa.int64())], names=["x", "y"])

    got = beside(rows(10), rows(21), lambda t: t.column("id").to_pylist(), answer, "x long, y long", block=block, part=4).collect()
    assert sorted((r["x"], r["y"]) for r in got) == sorted((x, y) for _ in "ab" for x in range(21) for y in range(10))


def test_linkage_shuffles_no_names_met_by_chance(spark):
    """The same 400 x 400 names under problem 3, each at a building of its own."""
    from weftwork.llm import linkage

    schema = "entity_id string, business_name string, business_address string, country string"
    rows = lambda s, names: spark.createDataFrame([(f"{s}-{i}", n, f"{i + 1} Polokade Street, Setroville, Oregon", "US") for i, n in enumerate(names)], schema)
    s1 = rows("S1", ["zenithal foods", *("abcdefghijkl" + w for w in words(1, "mnopqr", 400, 12))])
    s3 = rows("S3", ["zenithol foods", *("abcdefghijkl" + w for w in words(2, "stuvwx", 400, 12))])
    out = []
    assert shuffled(spark, lambda: out.extend(linkage.link_records(s1, s3).filter("name_level >= 2").collect())) < 100_000
    assert [(r["s1_id"], r["s3_id"]) for r in out] == [("S1-0", "S3-0")]


def test_all_keys_shuffles_records_only(spark, tmp_path):
    """A key of 200 records beside 200: 40,000 pairs, before a row of a shuffle each. An id in two countries adds up both."""
    from weftwork.plans import catalog

    rows = [(i, s, c, "n|all") for i in range(200) for s, c in ((1, "US"), (2, "US"))] + [(7, 1, "FR", "a|x"), (9, 2, "FR", "a|x"), (7, 1, None, "n|all"), (None, 2, "FR", "a|x")]
    spark.createDataFrame(rows, "id long, src byte, country string, key string").write.parquet(str(tmp_path / "blocking_keys.parquet"))
    query = next(r.queries["jn2_all_keys"] for r in catalog.registries() if "jn2_all_keys" in r.queries)
    out = []
    assert shuffled(spark, lambda: out.extend(query(spark, str(tmp_path)).collect())) < 10_000
    assert sorted((r["io"] or -1, r["i1"], r["n_shared"]) for r in out) == sorted([(x or -1, y, 1 + (x == 9 and y == 7)) for x in range(200) for y in range(200)] + [(-1, 7, 1)])


def plain_cosines(s1, o, least):
    """All pairs from ``least`` on, by the definition. s1, o: {id: text} of one country."""
    import math
    from collections import Counter

    grams = lambda t: Counter(x[i : i + 3] for x in [f" {t.replace(' ', '_')} "] for i in range(len(x) - 2))
    df = Counter(g for t in s1.values() for g in grams(t))

    def unit(t):
        v = {g: (1 + math.log(n)) * (math.log((1 + len(s1)) / (1 + df[g])) + 1) for g, n in grams(t).items() if g in df}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / length for g, x in v.items()}

    a, b = {i: unit(t) for i, t in s1.items()}, {i: unit(t) for i, t in o.items()}
    sims = {(y, x): sum(w * a[x].get(g, 0) for g, w in b[y].items()) for y in b for x in a}
    return {k: round(v, 6) for k, v in sims.items() if v >= least}


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_text_candidates_in_full(spark, least):
    """Common trigrams only, and more partners than one: all are found, with the cosine over all trigrams."""
    from weftwork.operators import blocking

    rng = random.Random(9)
    made = lambda n: " ".join(rng.choice(["polokade", "sanago", "foods"]) + rng.choice(["", "", "", "x", "qu"]) for _ in range(n))
    s1 = {i: made(1 + i % 4) for i in range(150)}
    o = {i: made(1 + i % 3) for i in range(80)}
    frame = lambda texts, name: spark.createDataFrame([(i, "US", t) for i, t in texts.items()], f"{name} int, country string, text string")
    rows = blocking.tfidf_candidates(frame(s1, "i1"), frame(o, "io"), top_n=None, max_df=None, min_sim=least).collect()
    got, want = {(r["io"], r["i1"]): round(r["tfidf_sim"], 6) for r in rows}, plain_cosines(s1, o, least)
    assert len(rows) == len(got) and got == want and len(want) > 200


def test_sparse_cosine_has_every_partner(spark, tmp_path):
    """names of common trigrams only had no partner before, and one at most."""
    from weftwork.plans import catalog

    schema = "entity_id string, business_name string, business_address string, country string"
    for k, names in ((1, ["Polokade"] * 30 + ["Sanago"] * 30), (2, ["Polokade", "Sanago"]), (3, ["Polokada"])):
        rows = [(f"S{k}-{100 * k + i}", n, f"{i + 1} Main Street, Setroville, Oregon", "US") for i, n in enumerate(names)]
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"source{k}.parquet"))
    query = next(r.queries["sm7_sparse_cosine"] for r in catalog.registries() if "sm7_sparse_cosine" in r.queries)
    rows = query(spark, str(tmp_path)).collect()
    assert len({(r["io"], r["i1"]) for r in rows}) == len(rows) == 90


def test_all_keys_shuffles_each_key_once(spark, tmp_path, monkeypatch):
    """blocks and parts are many, no record is shuffled to each of them (before, this took 27,000 rows)."""
    from collections import Counter

    from weftwork.plans import catalog, relational

    rng = random.Random(4)
    rows = [(i, s, "US", f"n|{rng.randrange(2500)}") for s, n in ((1, 3000), (2, 3000), (3, 3000)) for i in range(n)] + [(5, 1, "US", "n|0"), (5, 2, "US", "n|0")] * 2
    spark.createDataFrame(rows, "id int, src byte, country string, key string").write.parquet(str(tmp_path / "blocking_keys.parquet"))
    monkeypatch.setattr(relational, "BLOCK_KEYS", 700, raising=False)
    monkeypatch.setattr(relational, "PART_KEYS", 500, raising=False)
    query = next(r.queries["jn2_all_keys"] for r in catalog.registries() if "jn2_all_keys" in r.queries)
    out = []
    assert shuffled(spark, lambda: out.extend(query(spark, str(tmp_path)).collect())) < len(rows) + 100
    by = {}
    for i, k in {(i, k) for i, s, _, k in rows if s == 1}:
        by.setdefault(k, []).append(i)
    want = Counter((s, i, j) for i, s, k in {(i, s, k) for i, s, _, k in rows if s > 1} for j in by.get(k, []))
    assert {(r["src"], r["io"], r["i1"]): r["n_shared"] for r in out} == want and len(out) == len(want) > 6000


def test_centres_are_hashed_for_few_parts(spark):
    """8 zones of 25,000 readings; before, there were 32 cells of them, and 13 of 200,000 in one zone."""
    from pyspark.sql import functions as F

    from weftwork.operators import cells

    rows = lambda n, zones: spark.range(n * zones).select((F.col("id") % zones).cast("string").alias("zone"), "id")
    count = lambda n, zones: cells._sizes(rows(10, zones), rows(n, zones), 1 << 17, variants.PART).agg(F.sum(F.col("blocks") * F.col("parts")), F.min("parts")).first()
    assert tuple(count(25_000, 8)) == (8, 1) and tuple(count(200_000, 1)) == (4, 4)
