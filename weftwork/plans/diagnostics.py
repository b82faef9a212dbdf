"""Diagnostic queries around a matching: recall of the candidates, ranking, errors and their stages, shifts between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.similarity import ratio_of
from weftwork.operators import decide
from weftwork.operators.positions import with_positions
from weftwork.plans.er import BEST, F_HALF, PREDICTED, PRUNED, TRUTH, TRUTH_N, labelled, number, per_entity_sql, predicted, pruned, truth
from weftwork.plans.registry import Registry
from weftwork.plans.relational import OTHERS, SCORED, others, scored_pairs
from weftwork.session import table

REG = Registry()
q = REG.query

BANDS = [0.2, 0.3, 0.5, 0.8, 1.01]
GRID = [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9]


def edited_sql(label: str, name: str, pairs: str) -> str:
    """The measure over ``pairs`` (s1_id, o_id), a set made from h (predicted), g (true) and k (candidates)."""
    return f"""SELECT '{name}' AS {label}, round(avg(f), 9) AS macro_f05 FROM (WITH e0 AS ({pairs}), c AS (SELECT coalesce(e0.s1_id, g.s1_id) AS s1_id, count(CASE WHEN e0.o_id IS NOT NULL AND g.o_id IS NOT NULL THEN 1 END)::DOUBLE AS tp,
    count(e0.o_id)::DOUBLE AS n_pred, count(g.o_id)::DOUBLE AS n_true FROM e0 FULL JOIN g ON e0.s1_id = g.s1_id AND e0.o_id = g.o_id GROUP BY 1), e AS (SELECT coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true
    FROM match_labels l LEFT JOIN c ON c.s1_id = l.source1_entity_id) SELECT {F_HALF} AS f FROM e)"""


EDITED = f"WITH {TRUTH}, {PREDICTED}, h AS (SELECT DISTINCT s1_id, o_id FROM pd WHERE p >= 0.5), k AS (SELECT r.entity_id AS s1_id, o.entity_id AS o_id FROM s JOIN o USING (io) JOIN source1 r ON CAST(regexp_extract(r.entity_id, '-([0-9]+)$', 1) AS BIGINT) = s.i1) "


def true_pairs(spark, d) -> DataFrame:
    """``i1, io`` of the labels."""
    return truth(spark, d).select(number("s1_id").alias("i1"), number("o_id").alias("io"))


def r9(x, name):
    return F.round(x, 9).alias(name)


@q(
    "dg1_blocking_report",
    f"""WITH {SCORED}, {TRUTH_N}, h AS (SELECT gn.i1, gn.io, s.io IS NOT NULL AS hit FROM gn LEFT JOIN s ON s.io = gn.io AND s.i1 = gn.i1), e AS (SELECT h.i1, bool_and(hit) AS every_hit, count(*) AS n FROM h GROUP BY 1)
    SELECT (SELECT round(avg(hit::INT), 9) FROM h) AS pair_recall, (SELECT round(avg(every_hit::INT), 9) FROM e) AS all_match_recall, (SELECT count(*)::BIGINT FROM e) AS entities""",
)
def dg1(spark, d):
    hit = true_pairs(spark, d).join(scored_pairs(spark, d).select("io", "i1", F.lit(True).alias("hit")), ["io", "i1"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    pairs = hit.agg(r9(F.avg(F.col("hit").cast("double")), "pair_recall"))
    whole = hit.groupBy("i1").agg(F.bool_and("hit").alias("a")).agg(r9(F.avg(F.col("a").cast("double")), "all_match_recall"), F.count(F.lit(1)).alias("entities"))
    return pairs.crossJoin(whole)  # one row each


@q(
    "dg1_candidate_distribution",
    f"""WITH {SCORED}, c AS (SELECT r.country, r.entity_id, count(s.io) AS n FROM source1 r LEFT JOIN s ON s.i1 = CAST(regexp_extract(r.entity_id, '-([0-9]+)$', 1) AS BIGINT) GROUP BY 1, 2)
    SELECT country, round(avg(n), 6) AS mean, median(n) AS med, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n)::BIGINT AS most FROM c GROUP BY 1""",
)
def dg1b(spark, d):
    n = scored_pairs(spark, d).groupBy("i1").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "source1").select("country", number("entity_id").alias("i1")).join(n, "i1", "left").fillna(0, ["n"])
    at = lambda x: F.percentile("n", F.lit(x))
    return rows.groupBy("country").agg(F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("med"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("n").alias("most"))


@q(
    "dg2_threshold_grid",
    f"""WITH {TRUTH_N}, {SCORED}, l AS (SELECT CAST(regexp_extract(source1_entity_id, '-([0-9]+)$', 1) AS BIGINT) AS i1 FROM match_labels), x AS (SELECT s.io, s.i1, s.p, gn.io IS NOT NULL AS t, row_number() OVER (PARTITION BY s.io ORDER BY p DESC NULLS LAST, s.i1) = 1 AS top FROM s LEFT JOIN gn ON gn.io = s.io AND gn.i1 = s.i1),
    y AS (SELECT x.* FROM x JOIN l USING (i1)), tau AS (SELECT unnest({GRID}::DOUBLE[]) AS tau)
    SELECT tau, count(*)::BIGINT AS raw, count(CASE WHEN t THEN 1 END)::BIGINT AS raw_hits, count(CASE WHEN top THEN 1 END)::BIGINT AS assigned, count(CASE WHEN top AND t THEN 1 END)::BIGINT AS assigned_hits FROM y JOIN tau ON p >= tau GROUP BY 1""",
)
def dg2(spark, d):
    w = Window.partitionBy("io").orderBy(F.desc_nulls_last("p"), "i1")
    x = scored_pairs(spark, d).withColumn("top", F.row_number().over(w) == 1).join(true_pairs(spark, d).withColumn("t", F.lit(True)), ["io", "i1"], "left")
    y = x.join(labelled(spark, d).select(number("s1_id").alias("i1")), "i1")
    grid = F.broadcast(spark.createDataFrame([(t,) for t in GRID], "tau double"))  # 16 rows
    n = lambda c: F.count(F.when(c, 1))
    return y.join(grid, F.col("p") >= F.col("tau")).groupBy("tau").agg(F.count(F.lit(1)).alias("raw"), n(F.col("t")).alias("raw_hits"), n(F.col("top")).alias("assigned"), n(F.col("top") & F.col("t")).alias("assigned_hits"))


@q(
    "dg2_measures",
    f"""WITH {TRUTH}, {PREDICTED}, tau AS (SELECT unnest({GRID}::DOUBLE[]) AS tau), l AS (SELECT source1_entity_id AS s1_id FROM match_labels), g2 AS (SELECT g.s1_id, count(*)::DOUBLE AS n_true FROM g GROUP BY 1),
    h AS (SELECT tau, pd.s1_id, count(*)::DOUBLE AS n_pred, count(g.o_id)::DOUBLE AS tp FROM pd JOIN tau ON pd.p >= tau LEFT JOIN g ON g.s1_id = pd.s1_id AND g.o_id = pd.o_id GROUP BY 1, 2),
    e AS (SELECT tau.tau, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true FROM l CROSS JOIN tau LEFT JOIN g2 ON g2.s1_id = l.s1_id LEFT JOIN h ON h.s1_id = l.s1_id AND h.tau = tau.tau)
    SELECT tau, round(sum(tp) / nullif(sum(n_pred), 0), 9) AS precision, round(sum(tp) / nullif(sum(n_true), 0), 9) AS recall, round(avg({F_HALF}), 9) AS macro_f05, round(avg(n_pred), 9) AS avg_predicted FROM e GROUP BY 1""",
)
def dg2_measures(spark, d):
    """Precision, recall, macro F0.5 and predictions an entity at every threshold, from one pass over the assigned pairs."""
    best = decide.best_candidates(scored_pairs(spark, d)).filter("p IS NOT NULL")
    ids = labelled(spark, d).withColumn("i1", number("s1_id"))
    grid = F.broadcast(spark.createDataFrame([(t,) for t in GRID], "tau double"))  # 16 rows
    hit = best.join(true_pairs(spark, d).withColumn("t", F.lit(1)), ["io", "i1"], "left").join(ids.select("i1"), "i1", "left_semi")
    got = hit.join(grid, F.col("p") >= F.col("tau")).groupBy("tau", "i1").agg(F.count(F.lit(1)).alias("n_pred"), F.count("t").alias("tp"))
    wanted = true_pairs(spark, d).groupBy("i1").agg(F.count(F.lit(1)).alias("n_true"))
    rows = ids.select("i1").crossJoin(grid).join(wanted, "i1", "left").join(got, ["tau", "i1"], "left").fillna(0, ["n_pred", "tp", "n_true"])
    return rows.groupBy("tau").agg(r9(F.try_divide(F.sum("tp"), F.sum("n_pred")), "precision"), r9(F.try_divide(F.sum("tp"), F.sum("n_true")), "recall"), r9(F.avg(decide.f_half(F.col("tp"), F.col("n_pred"), F.col("n_true"))), "macro_f05"), r9(F.avg("n_pred"), "avg_predicted"))


TOPS = [1, 3, 5, 10, 20]


@q(
    "dg3_entity_ranking",
    f"""WITH {TRUTH_N}, {SCORED}, x AS (SELECT io, i1, row_number() OVER (PARTITION BY i1 ORDER BY p DESC NULLS LAST, io) AS r FROM s), n AS (SELECT i1, count(*) AS n_true FROM gn GROUP BY 1), t AS (SELECT i1, min(r) AS first, max(r) AS last, count(*) AS n_pool FROM x JOIN gn USING (io, i1) GROUP BY 1),
    k AS (SELECT n.*, first, last, n_pool FROM n LEFT JOIN t USING (i1)), tops AS (SELECT unnest({TOPS}::BIGINT[]) AS k)
    SELECT tops.k, round(avg(CASE WHEN first <= tops.k THEN 1.0 ELSE 0 END), 9) AS any_true, round(avg(coalesce(1.0 / first, 0)), 9) AS mrr, round(avg(CASE WHEN n_true >= 2 THEN CASE WHEN n_pool = n_true AND last <= tops.k THEN 1.0 ELSE 0 END END), 9) AS all_true FROM k CROSS JOIN tops GROUP BY 1""",
)
def dg3_entities(spark, d):
    """Ranking seen from the reference: is a true record, are all true records of those with several, among an entity's first k?"""
    w = Window.partitionBy("i1").orderBy(F.desc_nulls_last("p"), "io")
    true = true_pairs(spark, d)
    found = scored_pairs(spark, d).withColumn("r", F.row_number().over(w)).join(true, ["io", "i1"]).groupBy("i1").agg(F.min("r").alias("first"), F.max("r").alias("last"), F.count(F.lit(1)).alias("n_pool"))
    rows = true.groupBy("i1").agg(F.count(F.lit(1)).alias("n_true")).join(found, "i1", "left")
    tops = F.broadcast(spark.createDataFrame([(k,) for k in TOPS], "k long"))  # 5 rows
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    every = F.when(F.col("n_true") >= 2, F.coalesce((F.col("n_pool") == F.col("n_true")) & (F.col("last") <= F.col("k")), F.lit(False)).cast("double"))
    return rows.crossJoin(tops).groupBy("k").agg(r9(share(F.col("first") <= F.col("k")), "any_true"), r9(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), "mrr"), r9(F.avg(every), "all_true"))


@q(
    "dg3_ranking",
    f"""WITH {TRUTH_N}, {SCORED}, x AS (SELECT s.*, row_number() OVER (PARTITION BY io ORDER BY p DESC NULLS LAST, i1) AS rk FROM s), t AS (SELECT rk FROM x JOIN gn USING (io, i1))
    SELECT round(avg(1.0 / rk), 9) AS mrr, round(avg(CASE WHEN rk = 1 THEN 1.0 ELSE 0 END), 9) AS top1, round(avg(CASE WHEN rk <= 3 THEN 1.0 ELSE 0 END), 9) AS top3, count(*)::BIGINT AS n FROM t""",
)
def dg3(spark, d):
    w = Window.partitionBy("io").orderBy(F.desc_nulls_last("p"), "i1")
    t = scored_pairs(spark, d).withColumn("rk", F.row_number().over(w)).join(true_pairs(spark, d), ["io", "i1"])
    return t.agg(r9(F.avg(1 / F.col("rk")), "mrr"), r9(F.avg((F.col("rk") == 1).cast("double")), "top1"), r9(F.avg((F.col("rk") <= 3).cast("double")), "top3"), F.count(F.lit(1)).alias("n"))


#: Names of error patterns and the bounds that tell them, in order of precedence.
PATTERNS = [
    ("missing address", "addr_missing"),
    ("same address / different business", "ad_tset >= 90 AND core_tsort < 60"),
    ("same business name + street, different house number", "core_tsort >= 85 AND ad_tset >= 70 AND n_num_o > 0 AND n_num_1 > 0 AND NOT num0_eq"),
    ("legal-form confusion", "legal_conflict"),
    ("extra/missing business word", "core_tsort >= 70 AND (extra_tok_o > 0 OR extra_tok_1 > 0)"),
    ("common business name", "core_freq >= 3"),
    ("similar name / different address", "core_tsort >= 85 AND ad_tset < 60"),
    ("transliteration (Indic script)", "indic"),
    ("website / dba / alias", "webname OR alias"),
    ("near-identical (decoy)", "core_tsort >= 90 AND ad_tset >= 90"),
    ("name variation", "core_tsort < 60"),
]
MISSES = [
    ("missing address", "adc = ''"),
    ("transliteration (Indic script)", "indic"),
    ("name and address both very different", "core_tsort < 60 AND ad_tset < 60"),
    ("name variation (abbreviation / typo / alias)", "core_tsort < 60"),
    ("address variation", "ad_tset < 60"),
]


def first_that_holds(rules: list[tuple[str, str]], otherwise: str) -> F.Column:
    """The label of the first rule that holds; a rule on nulls doesn't."""
    held = F.filter(F.array(*[F.struct(F.lit(name).alias("name"), F.coalesce(F.expr(rule), F.lit(False)).alias("holds")) for name, rule in rules]), lambda x: x["holds"])
    return F.coalesce(F.get(held, F.lit(0))["name"], F.lit(otherwise))


@q("dg4_error_patterns")
def dg4(spark, d):
    """Patterns of the assigned pairs that the labels say are wrong."""
    from weftwork.operators import blocking, features
    from weftwork.plans.er import _prepared

    s1, o = _prepared(spark, d)
    ours = predicted(spark, d).join(labelled(spark, d), "s1_id").join(truth(spark, d), ["s1_id", "o_id"], "left_anti")
    wrong = ours.select(number("s1_id").alias("i1"), number("o_id").alias("io"))
    cands = blocking.reference_context(scored_pairs(spark, d)).join(wrong.select("io"), "io", "left_semi")
    rows = features.pair_features(cands, s1, o).join(wrong, ["io", "i1"])
    freq = s1.withColumn("core_freq", F.count(F.lit(1)).over(Window.partitionBy("country", "core"))).select("i1", "core_freq")
    return rows.join(freq, "i1").select("io", "i1", first_that_holds(PATTERNS, "other").alias("pattern"))


@q(
    "dg5_false_positives",
    f"""WITH {TRUTH}, {PREDICTED} SELECT CASE WHEN p < 0.8 THEN '[0.5,0.8)' ELSE '[0.8,1.01)' END AS band, left(pd.o_id, 2) AS src, count(*)::BIGINT AS n, median(p) AS med FROM pd JOIN match_labels l ON l.source1_entity_id = pd.s1_id
    WHERE p >= 0.5 AND NOT EXISTS (SELECT 1 FROM g WHERE g.s1_id = pd.s1_id AND g.o_id = pd.o_id) GROUP BY 1, 2""",
)
def dg5(spark, d):
    best = decide.best_candidates(scored_pairs(spark, d)).filter("p >= 0.5").select("io", "i1", "p")
    ids = labelled(spark, d).select("s1_id", number("s1_id").alias("i1"))
    o = others(spark, d).select("io", F.col("entity_id").alias("o_id"))
    wrong = best.join(ids, "i1").join(o, "io").join(truth(spark, d), ["s1_id", "o_id"], "left_anti")
    band = F.when(F.col("p") < 0.8, "[0.5,0.8)").otherwise("[0.8,1.01)")
    return wrong.groupBy(band.alias("band"), F.substring("o_id", 1, 2).alias("src")).agg(F.count(F.lit(1)).alias("n"), F.median("p").alias("med"))


@q(
    "dg6_missed_by_stage",
    f"""WITH {TRUTH_N}, {BEST}, m AS (SELECT gn.* FROM gn LEFT JOIN b ON b.io = gn.io AND b.i1 = gn.i1 AND b.p >= 0.5 WHERE b.io IS NULL),
    x AS (SELECT m.io, m.i1, s.io IS NOT NULL AS found, s.p, b.i1 AS top FROM m LEFT JOIN s ON s.io = m.io AND s.i1 = m.i1 LEFT JOIN b ON b.io = m.io)
    SELECT CASE WHEN NOT found THEN 'never generated' WHEN top <> i1 THEN 'another S1 scored higher' WHEN p < 0.05 THEN 'ranked first, low score' ELSE 'ranked first, just below threshold' END AS stage, count(*)::BIGINT AS n FROM x GROUP BY 1""",
)
def dg6(spark, d):
    s = scored_pairs(spark, d)
    best = decide.best_candidates(s)
    missed = true_pairs(spark, d).join(best.filter("p >= 0.5").select("io", "i1"), ["io", "i1"], "left_anti")
    x = missed.join(s.select("io", "i1", "p", F.lit(True).alias("found")), ["io", "i1"], "left").join(best.select("io", F.col("i1").alias("top")), "io", "left")
    stage = F.when(F.col("found").isNull(), "never generated").when(F.col("top") != F.col("i1"), "another S1 scored higher").when(F.col("p") < 0.05, "ranked first, low score").otherwise("ranked first, just below threshold")
    return x.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@q("dg6_blocking_misses")
def dg6b(spark, d):
    """Why true pairs are no candidates, from the likeness of what is known of both sides."""
    from weftwork.operators import features
    from weftwork.plans.er import _prepared

    s1, o = _prepared(spark, d)
    missed = true_pairs(spark, d).join(scored_pairs(spark, d).select("io", "i1"), ["io", "i1"], "left_anti")
    right = s1.select("i1", *[F.col(c).alias(f"{c}_1") for c in ("nm", "core", "adc")])
    rows = features.text_scores(missed.join(o.select("io", "nm", "core", "adc", "indic"), "io").join(right, "i1"))
    return rows.groupBy(first_that_holds(MISSES, "similar text but crowded out of top-k").alias("why")).agg(F.count(F.lit(1)).alias("n"))


def _entities(spark, d) -> DataFrame:
    return decide.per_entity(labelled(spark, d), predicted(spark, d), truth(spark, d))


@q(
    "dg7_multi_match_loss",
    f"""WITH {per_entity_sql()} SELECT CASE WHEN n_true >= 5 THEN '5+' ELSE n_true::INT::VARCHAR END AS bucket, count(*)::BIGINT AS entities, round(avg(f), 9) AS macro_f05, round(coalesce(sum(1 - f) / nullif(sum(sum(1 - f)) OVER (), 0), 0), 9) AS share_of_loss FROM f GROUP BY 1""",
)
def dg7(spark, d):
    bucket = F.when(F.col("n_true") >= 5, "5+").otherwise(F.col("n_true").cast("string"))
    by = _entities(spark, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("entities"), r9(F.avg("f"), "macro_f05"), F.sum(1 - F.col("f")).alias("loss"))
    whole = by.agg(F.sum("loss").alias("whole"))
    return by.crossJoin(F.broadcast(whole)).select("bucket", "entities", "macro_f05", F.round(F.coalesce(F.try_divide("loss", "whole"), F.lit(0.0)), 9).alias("share_of_loss"))


@q("dg8_by_country", f"WITH {per_entity_sql()} SELECT country, count(*)::BIGINT AS entities, round(avg(f), 9) AS macro_f05, round(sum(tp) / nullif(sum(n_true), 0), 9) AS recall FROM f JOIN source1 ON entity_id = s1_id GROUP BY 1")
def dg8(spark, d):
    rows = _entities(spark, d).join(table(spark, d, "source1").select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("entities"), r9(F.avg("f"), "macro_f05"), r9(F.try_divide(F.sum("tp"), F.sum("n_true")), "recall"))


@q(
    "dg8_source_if_perfect",
    EDITED + " UNION ALL ".join(edited_sql("src", x, f"SELECT * FROM h WHERE left(o_id, 2) <> '{x}' UNION SELECT * FROM g WHERE left(o_id, 2) = '{x}'") for x in ("S2", "S3")),
)
def dg8b(spark, d):
    """The measure if all pairs of one source were right: its own predictions exchanged for the truth."""
    p, t, ids = predicted(spark, d), truth(spark, d), labelled(spark, d)
    out = None
    for src in ("S2", "S3"):
        fixed = p.filter(~F.col("o_id").startswith(src)).unionByName(t.filter(F.col("o_id").startswith(src)))
        row = decide.macro_f_half(ids, fixed, t).select(F.lit(src).alias("src"), r9("macro_f05", "macro_f05"))
        out = row if out is None else out.unionByName(row)
    return out


@q(
    "dg9_counterfactuals",
    EDITED + " UNION ALL ".join([
        edited_sql('"case"', "baseline", "SELECT * FROM h"), edited_sql('"case"', "no false positives", "SELECT * FROM h INTERSECT SELECT * FROM g"), edited_sql('"case"', "no misses", "SELECT * FROM h UNION SELECT * FROM g"),
        edited_sql('"case"', "no misses among candidates", "SELECT * FROM h UNION (SELECT * FROM g INTERSECT SELECT * FROM k)"), edited_sql('"case"', "no unowned records", "SELECT * FROM h WHERE o_id IN (SELECT o_id FROM g)"),
        edited_sql('"case"', "no misses outside candidates", "SELECT * FROM h UNION (SELECT * FROM g EXCEPT SELECT * FROM k)"), edited_sql('"case"', "perfect decisions on candidates", "SELECT * FROM g INTERSECT SELECT * FROM k"),
    ]),
)
def dg9(spark, d):
    """The measure as it is, without wrong pairs, with all missed ones, with those that are candidates or those that are not, without unowned records, and with the true pairs among the candidates alone."""
    p, t, ids = predicted(spark, d), truth(spark, d), labelled(spark, d)
    ref = ids.select("s1_id", number("s1_id").alias("i1"))
    cands = scored_pairs(spark, d).select("io", "i1").join(ref, "i1").join(others(spark, d).select("io", F.col("entity_id").alias("o_id")), "io").select("s1_id", "o_id")
    cases = {
        "baseline": p, "no false positives": p.join(t, ["s1_id", "o_id"], "left_semi"), "no misses": p.unionByName(t),
        "no misses among candidates": p.unionByName(t.join(cands, ["s1_id", "o_id"], "left_semi")), "no unowned records": p.join(t.select("o_id").distinct(), "o_id", "left_semi").select("s1_id", "o_id"),
        "no misses outside candidates": p.unionByName(t.join(cands, ["s1_id", "o_id"], "left_anti")), "perfect decisions on candidates": t.join(cands, ["s1_id", "o_id"], "left_semi"),
    }
    out = None
    for name, pairs in cases.items():
        row = decide.macro_f_half(ids, pairs, t).select(F.lit(name).alias("case"), r9("macro_f05", "macro_f05"))
        out = row if out is None else out.unionByName(row)
    return out


@q(
    "dg11_by_country_and_source",
    f"""WITH {OTHERS} SELECT country, src, count(*)::BIGINT AS n, round(avg(CASE WHEN coalesce(business_address, '') = '' THEN 1.0 ELSE 0 END), 9) AS no_address, count(DISTINCT business_name)::BIGINT AS names FROM o GROUP BY 1, 2""",
)
def dg11(spark, d):
    return others(spark, d).groupBy("country", "src").agg(F.count(F.lit(1)).alias("n"), r9(F.avg((F.coalesce("business_address", F.lit("")) == "").cast("double")), "no_address"), F.countDistinct("business_name").alias("names"))


@q(
    "dg12_density_cells",
    f"""WITH {OTHERS}, {SCORED}, b AS (SELECT io, p FROM (SELECT io, p, row_number() OVER (PARTITION BY io ORDER BY p DESC NULLS LAST, i1) AS n FROM s) WHERE n = 1 AND p IS NOT NULL),
    c AS (SELECT src, country, CASE WHEN p <= 0.3 THEN 0 WHEN p <= 0.85 THEN 1 ELSE 2 END AS cell, count(*) AS n FROM b JOIN o USING (io) GROUP BY 1, 2, 3),
    h AS (SELECT country, cell, n / sum(n) OVER () AS sh FROM c WHERE src = 2), t AS (SELECT country, cell, n / sum(n) OVER () AS sh FROM c WHERE src = 3)
    SELECT country, cell::INTEGER AS cell, round(coalesce(h.sh, 0), 9) AS share_2, round(coalesce(t.sh, 0), 9) AS share_3, round(coalesce(t.sh, 0) / nullif(h.sh, 0), 9) AS ratio FROM h FULL JOIN t USING (country, cell)""",
)
def dg12(spark, d):
    best = decide.best_candidates(scored_pairs(spark, d)).filter("p IS NOT NULL").join(others(spark, d).select("io", "src", "country"), "io")
    cell = F.when(F.col("p") <= 0.3, 0).when(F.col("p") <= 0.85, 1).otherwise(2)
    n = best.groupBy("src", "country", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))

    def shares(src: int) -> DataFrame:
        own = n.filter(F.col("src") == src)
        return own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("whole")))).select("country", "cell", (F.col("n") / F.col("whole")).alias(f"s{src}"))

    both = shares(2).join(shares(3), ["country", "cell"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("country", "cell", r9(zero("s2"), "share_2"), r9(zero("s3"), "share_3"), r9(F.try_divide(zero("s3"), F.col("s2")), "ratio"))


@q("dg13_unsure_profile", f"WITH {BEST} SELECT p >= 0.2 AND p < 0.85 AS unsure, count(*)::BIGINT AS n, round(avg(s.block_score), 6) AS block_score, round(avg(s.n_shared), 6) AS n_shared, round(avg(s.tfidf_sim), 6) AS tfidf_sim FROM b JOIN s USING (io, i1, p) WHERE p IS NOT NULL GROUP BY 1")
def dg13(spark, d):
    rows = decide.best_candidates(scored_pairs(spark, d)).filter("p IS NOT NULL")
    unsure = (F.col("p") >= 0.2) & (F.col("p") < 0.85)
    return rows.groupBy(unsure.alias("unsure")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("block_score", "n_shared", "tfidf_sim")])


@q(
    "dg14_first_and_second",
    f"""WITH {OTHERS}, {SCORED}, x AS (SELECT io, p, row_number() OVER (PARTITION BY io ORDER BY p DESC NULLS LAST, i1) AS n FROM s), t AS (SELECT io, max(CASE WHEN n = 1 THEN p END) AS p1, coalesce(max(CASE WHEN n = 2 THEN p END), 0) AS p2 FROM x GROUP BY 1)
    SELECT country, count(*)::BIGINT AS n, count(CASE WHEN p1 >= 0.85 THEN 1 END)::BIGINT AS sure, count(CASE WHEN p1 >= 0.5 AND p1 - p2 < 0.2 THEN 1 END)::BIGINT AS close FROM t JOIN o USING (io) GROUP BY 1""",
)
def dg14(spark, d):
    w = Window.partitionBy("io").orderBy(F.desc_nulls_last("p"), "i1")
    x = scored_pairs(spark, d).withColumn("n", F.row_number().over(w))
    t = x.groupBy("io").agg(F.max(F.when(F.col("n") == 1, F.col("p"))).alias("p1"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("p"))), F.lit(0.0)).alias("p2"))
    n = lambda c: F.count(F.when(c, 1))
    return t.join(others(spark, d).select("io", "country"), "io").groupBy("country").agg(F.count(F.lit(1)).alias("n"), n(F.col("p1") >= 0.85).alias("sure"), n((F.col("p1") >= 0.5) & (F.col("p1") - F.col("p2") < 0.2)).alias("close"))


@q("dg14_magnets", f"WITH {BEST} SELECT i1, count(*)::BIGINT AS n FROM b WHERE p >= 0.5 GROUP BY 1 ORDER BY n DESC, i1 LIMIT 20")
def dg14b(spark, d):
    """The reference records that most records choose: a report of 20."""
    return decide.assign(scored_pairs(spark, d), 0.5).groupBy("i1").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "i1").limit(20)


@q("dg15_twins")
def dg15(spark, d):
    """For records that claim one reference record: the likest other name, the fewest edits, whether one of its source is among them."""
    o = others(spark, d).select("io", "src", F.coalesce("business_name", F.lit("")).alias("nm"))
    claims = decide.assign(scored_pairs(spark, d), 0.5).join(o, "io")
    twins = claims.join(claims.select("i1", F.col("io").alias("io2"), F.col("src").alias("src2"), F.col("nm").alias("nm2")), "i1").filter("io <> io2")
    twins = twins.withColumn("sim", ratio_of(F.col("nm"), F.col("nm2")))
    return twins.groupBy("io", "i1").agg(F.round(F.max("sim"), 6).alias("max_sim"), F.min(F.levenshtein("nm", "nm2")).alias("min_edits"), F.bool_or(F.col("src") == F.col("src2")).alias("same_src"), F.count(F.lit(1)).alias("n_twins"))


@q(
    "dg16_swap",
    f"""WITH {BEST}, a AS (SELECT io, i1 FROM b WHERE p >= 0.5), k AS (SELECT io, i1 FROM (SELECT *, row_number() OVER (PARTITION BY io ORDER BY block_score DESC NULLS LAST, i1) AS n FROM s) WHERE n = 1 AND block_score >= 30)
    SELECT CASE WHEN a.io IS NULL THEN 'added' WHEN k.io IS NULL THEN 'removed' ELSE 'kept' END AS side, count(*)::BIGINT AS n FROM a FULL JOIN k ON a.io = k.io AND a.i1 = k.i1 GROUP BY 1""",
)
def dg16(spark, d):
    s = scored_pairs(spark, d)
    a = decide.assign(s, 0.5).withColumn("was", F.lit(True))
    b = decide.assign(s, 30, "block_score").withColumn("is", F.lit(True))
    side = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("kept")
    return a.join(b, ["io", "i1"], "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@q("dg17_count_curve", " UNION ALL ".join(f"SELECT {n}::BIGINT AS wanted, (WITH {BEST} SELECT min(p) FROM (SELECT p FROM b WHERE p IS NOT NULL ORDER BY p DESC LIMIT {n})) AS tau" for n in (50, 200, 800)))
def dg17(spark, d):
    """The threshold that gives a wanted number of matches."""
    best = decide.best_candidates(scored_pairs(spark, d)).filter("p IS NOT NULL").select("p")
    out = None
    for n in (50, 200, 800):
        row = best.orderBy(F.desc("p")).limit(n).agg(F.lit(n).cast("bigint").alias("wanted"), F.min("p").alias("tau"))
        out = row if out is None else out.unionByName(row)
    return out


@q(
    "dg17_harshness",
    f"""WITH {TRUTH}, {PREDICTED}, h AS (SELECT pd.s1_id, pd.o_id FROM pd JOIN match_labels l ON l.source1_entity_id = pd.s1_id WHERE p >= 0.5), x AS (SELECT h.s1_id, h.o_id, g.o_id IS NOT NULL AS t FROM h LEFT JOIN g ON g.s1_id = h.s1_id AND g.o_id = h.o_id), k AS (SELECT unnest([2, 3, 4, 6, 8]) AS k)
    SELECT k::INTEGER AS k, count(CASE WHEN t THEN 1 END)::BIGINT AS hits, sum(CASE WHEN t THEN 1 ELSE k END)::BIGINT AS n_pred FROM x, k GROUP BY 1""",
)
def dg17b(spark, d):
    """False matches replicated k - 1 times, as in a denser set."""
    t = truth(spark, d).withColumn("t", F.lit(True))
    x = predicted(spark, d).join(labelled(spark, d), "s1_id").join(t, ["s1_id", "o_id"], "left")
    ks = F.explode(F.array(*[F.lit(k) for k in (2, 3, 4, 6, 8)]))
    copies = x.withColumn("k", ks).withColumn("copy", F.explode(F.when(F.col("t"), F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.col("k")))))
    return copies.groupBy("k").agg(F.count("t").alias("hits"), F.count(F.lit(1)).alias("n_pred"))


@q(
    "dg18_ranked_auc",
    f"""WITH {TRUTH_N}, {SCORED}, l AS (SELECT CAST(regexp_extract(source1_entity_id, '-([0-9]+)$', 1) AS BIGINT) AS i1 FROM match_labels), x AS (SELECT s.p, gn.io IS NOT NULL AS y FROM s JOIN l USING (i1) LEFT JOIN gn ON gn.io = s.io AND gn.i1 = s.i1 WHERE p IS NOT NULL),
    r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM x), a AS (SELECT sum(CASE WHEN y THEN rk END) AS s, count(CASE WHEN y THEN 1 END) AS n1, count(CASE WHEN NOT y THEN 1 END) AS n0 FROM r)
    SELECT round((s - n1 * (n1 + 1) / 2.0) / (n1 * n0), 9) AS auc, n1::BIGINT AS positives, n0::BIGINT AS negatives FROM a""",
)
def dg18(spark, d):
    """Exact area under the curve by rank sums: positions of a range-partitioned sort, equal scores sharing the mean of theirs."""
    x = scored_pairs(spark, d).filter("p IS NOT NULL").join(labelled(spark, d).select(number("s1_id").alias("i1")), "i1").join(true_pairs(spark, d).withColumn("t", F.lit(1)), ["io", "i1"], "left")
    placed = with_positions(x.select("p", "t", "io", "i1", F.lit(0).alias("one")), ["one"], ["p", "io", "i1"], "place")
    v = placed.groupBy("p").agg(F.count("t").cast("double").alias("pos"), F.count(F.lit(1)).alias("n"), ((F.min("place") + F.max("place")) / 2).alias("rank"))
    w = v.agg(F.sum("pos").alias("n1"), F.sum(F.col("n") - F.col("pos")).alias("n0"), F.sum(F.col("pos") * F.col("rank")).alias("ranks"))
    wins = F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2
    return w.select(r9(F.try_divide(wins, F.col("n1") * F.col("n0")), "auc"), F.col("n1").cast("long").alias("positives"), F.col("n0").cast("long").alias("negatives"))


@q(
    "dg19_profile",
    r"""SELECT country, count(*)::BIGINT AS n, count(CASE WHEN coalesce(business_name, '') = '' THEN 1 END)::BIGINT AS no_name, count(CASE WHEN coalesce(business_address, '') = '' THEN 1 END)::BIGINT AS no_address,
    count(CASE WHEN regexp_matches(business_name, '[\x{0900}-\x{097F}]') THEN 1 END)::BIGINT AS devanagari, count(CASE WHEN NOT regexp_matches(business_name, '^[\x00-\x7F]*$') THEN 1 END)::BIGINT AS non_ascii,
    median(length(business_name)) AS med_name, median(length(business_address)) AS med_address, count(DISTINCT entity_id)::BIGINT AS ids FROM source3 GROUP BY 1""",
)
def dg19(spark, d):
    n = lambda c: F.count(F.when(c, 1))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return table(spark, d, "source3").groupBy("country").agg(
        F.count(F.lit(1)).alias("n"), n(empty("business_name")).alias("no_name"), n(empty("business_address")).alias("no_address"), n(F.col("business_name").rlike("[\\u0900-\\u097F]")).alias("devanagari"),
        n(~F.col("business_name").rlike(r"^[\x00-\x7F]*$")).alias("non_ascii"), F.median(F.char_length("business_name")).alias("med_name"), F.median(F.char_length("business_address")).alias("med_address"), F.countDistinct("entity_id").alias("ids"))


@q("dg19_match_counts", f"WITH {TRUTH}, c AS (SELECT source1_entity_id, count(g.o_id) AS n FROM match_labels l LEFT JOIN g ON g.s1_id = l.source1_entity_id GROUP BY 1) SELECT n::BIGINT AS matches, count(*)::BIGINT AS entities FROM c GROUP BY 1")
def dg19b(spark, d):
    n = labelled(spark, d).join(truth(spark, d), "s1_id", "left").groupBy("s1_id").agg(F.count("o_id").alias("matches"))
    return n.groupBy("matches").agg(F.count(F.lit(1)).alias("entities"))


@q("ml6_prune_report", f"WITH {TRUTH_N}, {PRUNED}, n1 AS (SELECT count(*) AS n FROM source1) SELECT round((SELECT count(*) FROM ps) / n1.n, 9) AS pairs_per_s1, round((SELECT count(*) FROM gn JOIN ps USING (io, i1)) / (SELECT count(*) FROM gn), 9) AS link_recall FROM n1")
def ml6(spark, d):
    kept, true = pruned(spark, d).select("io", "i1"), true_pairs(spark, d)
    n = kept.agg(F.count(F.lit(1)).alias("n")).crossJoin(table(spark, d, "source1").agg(F.count(F.lit(1)).alias("s1")))
    hit = true.join(kept.withColumn("k", F.lit(1)), ["io", "i1"], "left").agg(r9(F.try_divide(F.count("k"), F.count(F.lit(1))), "link_recall"))
    return n.crossJoin(hit).select(r9(F.try_divide("n", "s1"), "pairs_per_s1"), "link_recall")  # one row each


PRUNINGS = [(0.001, 5), (0.005, 3), (0.01, 3), (0.02, 3), (0.05, 2)]


@q(
    "ml6_prune_settings",
    f"""WITH {TRUTH_N}, {SCORED}, x AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY p DESC NULLS LAST, i1) AS n FROM s), c AS (SELECT * FROM (VALUES {", ".join(f"({a}::DOUBLE, {b})" for a, b in PRUNINGS)}) AS v(least, top)),
    k AS (SELECT least, top, count(*) AS pairs, count(gn.io) AS hits FROM x JOIN c ON x.p >= c.least AND x.n <= c.top LEFT JOIN gn ON gn.io = x.io AND gn.i1 = x.i1 GROUP BY 1, 2)
    SELECT least, top, round(pairs / (SELECT count(*) FROM source1), 9) AS pairs_per_s1, round(hits / nullif((SELECT count(*) FROM gn), 0), 9) AS link_recall FROM k""",
)
def ml6_settings(spark, d):
    """Candidates an entity and links kept at each setting of the filter."""
    w = Window.partitionBy("io").orderBy(F.desc_nulls_last("p"), "i1")
    x = scored_pairs(spark, d).withColumn("n", F.row_number().over(w)).join(true_pairs(spark, d).withColumn("t", F.lit(1)), ["io", "i1"], "left")
    grid = F.broadcast(spark.createDataFrame(PRUNINGS, "least double, top int"))  # 5 rows
    kept = x.join(grid, (F.col("p") >= F.col("least")) & (F.col("n") <= F.col("top"))).groupBy("least", "top").agg(F.count(F.lit(1)).alias("pairs"), F.count("t").alias("hits"))
    whole = table(spark, d, "source1").agg(F.count(F.lit(1)).alias("s1")).crossJoin(true_pairs(spark, d).agg(F.count(F.lit(1)).alias("links")))  # one row
    return kept.crossJoin(whole).select("least", "top", r9(F.try_divide("pairs", "s1"), "pairs_per_s1"), r9(F.try_divide("hits", "links"), "link_recall"))


#: Bounds of the score bands of the density correction.
DENSITY_BANDS = [0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98]


@q(
    "dg12_density_correction",
    f"""WITH {TRUTH_N}, {OTHERS}, {SCORED}, b AS (SELECT s.io, s.i1, p, src, country, CASE {" ".join(f"WHEN p <= {x} THEN {i}" for i, x in enumerate(DENSITY_BANDS))} ELSE {len(DENSITY_BANDS)} END AS band FROM (SELECT *, row_number() OVER (PARTITION BY io ORDER BY p DESC NULLS LAST, i1) AS n FROM s) s JOIN o USING (io) WHERE n = 1 AND p IS NOT NULL),
    x AS (SELECT country, band, count(CASE WHEN src = 2 THEN 1 END) AS n_h, count(CASE WHEN src = 3 THEN 1 END) AS n_t, avg(CASE WHEN src = 2 THEN CASE WHEN gn.io IS NULL THEN 0.0 ELSE 1.0 END END) AS prec FROM b LEFT JOIN gn ON gn.io = b.io AND gn.i1 = b.i1 GROUP BY 1, 2),
    z AS (SELECT *, n_h / sum(n_h) OVER () AS sh, n_t / sum(n_t) OVER () AS st FROM x), y AS (SELECT *, st / nullif(sh, 0) AS w FROM z), pi AS (SELECT sum(CASE WHEN band = {len(DENSITY_BANDS)} THEN st END) / nullif(sum(CASE WHEN band = {len(DENSITY_BANDS)} THEN sh END), 0) AS pi FROM y)
    SELECT country, band::INT AS band, n_h::BIGINT AS n_2, n_t::BIGINT AS n_3, round(prec, 9) AS prec, round(w, 9) AS w, round(pi, 9) AS pi, round(prec * least(1.0, pi / nullif(w, 0)), 9) AS corrected FROM y CROSS JOIN pi""",
)
def dg12_correction(spark, d):
    """What precision, measured where labels are, becomes where a cell is denser: the surest band tells the share pi of records that are of
    the list at all, a cell's density ratio w how many more it has, and prec * min(1, pi / w) is left."""
    top = len(DENSITY_BANDS)
    band = F.lit(top)
    for i in reversed(range(top)):
        band = F.when(F.col("p") <= DENSITY_BANDS[i], i).otherwise(band)
    best = decide.best_candidates(scored_pairs(spark, d)).filter("p IS NOT NULL").join(others(spark, d).select("io", "src", "country"), "io")
    hit = best.withColumn("band", band).join(true_pairs(spark, d).withColumn("t", F.lit(1)), ["io", "i1"], "left")
    of = lambda src: F.count(F.when(F.col("src") == src, 1))
    cells = hit.groupBy("country", "band").agg(of(2).alias("n_2"), of(3).alias("n_3"), F.avg(F.when(F.col("src") == 2, F.when(F.col("t").isNull(), 0.0).otherwise(1.0))).alias("prec"))
    sums = cells.agg(F.sum("n_2").alias("all_2"), F.sum("n_3").alias("all_3"), F.sum(F.when(F.col("band") == top, F.col("n_2"))).alias("sure_2"), F.sum(F.when(F.col("band") == top, F.col("n_3"))).alias("sure_3"))
    rows = cells.crossJoin(F.broadcast(sums))  # one row
    share = lambda n, whole: F.try_divide(F.col(n), F.col(whole))
    rows = rows.withColumns({"w": F.try_divide(share("n_3", "all_3"), share("n_2", "all_2")), "pi": F.try_divide(share("sure_3", "all_3"), share("sure_2", "all_2"))})
    return rows.select("country", F.col("band").cast("int").alias("band"), "n_2", "n_3", r9(F.col("prec"), "prec"), r9(F.col("w"), "w"), r9(F.col("pi"), "pi"), r9(F.col("prec") * F.least(F.lit(1.0), F.try_divide("pi", "w")), "corrected"))
