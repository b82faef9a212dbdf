"""Queries of the classifier cascade. A learner's result is no SQL, so these are checked by tests on what must hold of them."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.similarity import token_set_ratio, token_sort_ratio
from weftwork.operators import blocking, features, models
from weftwork.plans.diagnostics import true_pairs
from weftwork.plans.er import TRUTH_N, _prepared, labelled, number, pruned
from weftwork.plans.registry import Registry
from weftwork.plans.relational import SCORED, others, scored_pairs
from weftwork.session import cut, table

REG = Registry()
q = REG.query

#: The cheap columns by which the first model filters; no Python is needed for them.
FILTER_COLUMNS = ["block_score", "n_shared", "tfidf_sim", "n_cand_o", "rank_block", "gap_block", "n_cand_1", "rank_block_1"]


def _candidates(spark, d) -> DataFrame:
    """Scored pairs of the labelled reference records with their standing; who owns what is known of those only."""
    from pyspark.sql import Window

    w = Window.partitionBy("io")
    rows = blocking.reference_context(scored_pairs(spark, d))
    rows = rows.withColumns({"n_cand_o": F.count(F.lit(1)).over(w), "rank_block": F.row_number().over(w.orderBy(F.desc("block_score"), "i1")), "gap_block": F.max("block_score").over(w) - F.col("block_score")})
    return rows.withColumn("rank_combo", F.row_number().over(w.orderBy(F.desc(F.col("block_score") + 10 * F.col("tfidf_sim")), "i1")))


def _labelled(spark, d) -> DataFrame:
    known = labelled(spark, d).select(number("s1_id").alias("i1"))
    rows = models.labelled_pairs(_candidates(spark, d), true_pairs(spark, d), blocking.anchors(scored_pairs(spark, d)))
    return rows.join(known, "i1", "left_semi")


@q("ml1_label_and_split", f"WITH {TRUTH_N}, {SCORED} SELECT s.io, s.i1, (own.i1 IS NOT NULL AND own.i1 = s.i1)::INT::DOUBLE AS y FROM s LEFT JOIN (SELECT io, min(i1) AS i1 FROM gn GROUP BY 1) own ON own.io = s.io")
def ml1(spark, d):
    rows = models.labelled_pairs(scored_pairs(spark, d), true_pairs(spark, d), blocking.anchors(scored_pairs(spark, d)))
    return rows.select("io", "i1", "y")


@q("ml2_decoys_follow_anchor", f"WITH {TRUTH_N}, {SCORED}, a AS (SELECT io, i1 AS parent FROM (SELECT *, row_number() OVER (PARTITION BY io ORDER BY block_score DESC, i1) AS n FROM s) WHERE n = 1), w AS (SELECT io, min(i1) AS owner FROM gn GROUP BY 1) SELECT coalesce(owner, parent) AS anchor, count(DISTINCT s.io) AS records, count(*) AS pairs, 1::BIGINT AS sides FROM s JOIN a USING (io) LEFT JOIN w USING (io) GROUP BY 1")
def ml2(spark, d):
    """The records and pairs of each anchor or owner, and on how many sides of the holdout they stand: on one."""
    anchors = blocking.anchors(scored_pairs(spark, d))
    rows = models.labelled_pairs(scored_pairs(spark, d), true_pairs(spark, d), anchors).join(anchors, "io")
    return rows.groupBy(F.coalesce("owner", "parent").alias("anchor")).agg(F.countDistinct("io").alias("records"), F.count(F.lit(1)).alias("pairs"), F.countDistinct("val").alias("sides"))


@q("ml3_training_rows")
def ml3(spark, d):
    return models.training_rows(_labelled(spark, d)).select("io", "i1", "y", "weight")


@q("ml4_out_of_fold")
def ml4(spark, d):
    rows = cut(_labelled(spark, d))
    return models.out_of_fold(rows, FILTER_COLUMNS, learner="logistic", rounds=40)[0].select("io", "i1", "fold", F.round("p1", 6).alias("p1"))


#: The columns of the whole filter, with likenesses and numbers.
WHOLE_FILTER_COLUMNS = [*FILTER_COLUMNS, "nm_ratio", "core_tsort", "core_jw", "ad_tset", "num_common", "num0_eq", "hn_min_logdiff", "combo", "rank_combo", "gap_combo", "src", "addr_missing"]


def filtered(spark, d, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """The 50 features of every scored pair with owner, fold and holdout, and ``io, i1, p1`` of every one: boosted trees, out of fold for
    pairs of labelled reference records, the mean of both models for all others."""
    s1, o = _prepared(spark, d)
    feats = features.pair_features(blocking.reference_context(scored_pairs(spark, d)), s1, o)
    rows = cut(models.labelled_pairs(feats, true_pairs(spark, d), blocking.anchors(scored_pairs(spark, d))))
    numbers, columns = models.numeric(rows, WHOLE_FILTER_COLUMNS)
    known = labelled(spark, d).select(number("s1_id").alias("i1"))
    seen, unseen = models.out_of_fold(cut(numbers.join(known, "i1", "left_semi")), columns, rounds=rounds, unseen=numbers.join(known, "i1", "left_anti"))
    return rows, cut(seen.select("io", "i1", "p1").unionByName(unseen.select("io", "i1", "p1")))


@q("ml4_filter_all_pairs")
def ml4b(spark, d):
    return filtered(spark, d)[1].withColumn("p1", F.round("p1", 6))


@q("ml5_prune", "WITH s AS (SELECT io, i1, max(CASE WHEN isnan(p) THEN NULL ELSE p END) AS p FROM candidate_pairs GROUP BY 1, 2), o AS (SELECT DISTINCT CAST(regexp_extract(entity_id, '-([0-9]+)$', 1) AS BIGINT) AS io FROM (SELECT entity_id FROM source2 UNION ALL SELECT entity_id FROM source3)) SELECT io, i1, p AS p1 FROM (SELECT *, row_number() OVER (PARTITION BY io ORDER BY p DESC NULLS LAST, i1) AS n FROM s WHERE p IS NOT NULL) JOIN o USING (io) WHERE n <= 3 AND p >= 0.01")
def ml5(spark, d):
    return pruned(spark, d).select("io", "i1", "p1")


@q("ml7_9_final_scores")
def ml7(spark, d):
    """Boosted trees over candidate and competition columns of the pruned pairs, stopped by the holdout, scored over all pruned pairs."""
    rows = pruned(spark, d).drop("src").join(_candidates(spark, d), ["io", "i1"])
    comp = features.competition(pruned(spark, d)).drop("p1")
    rows = models.labelled_pairs(rows.join(comp, ["io", "i1"]), true_pairs(spark, d), blocking.anchors(scored_pairs(spark, d)))
    columns = [*FILTER_COLUMNS, *[c for c in features.COMPETITION]]
    rows, columns = models.numeric(cut(rows), columns)
    known = rows.join(labelled(spark, d).select(number("s1_id").alias("i1")), "i1", "left_semi").withColumn("w", F.when(F.col("owner").isNull(), 2.0).otherwise(1.0))
    model = models.fit(known, columns, rounds=12, depth=4, weight="w", validation="val")
    return models.score(model, rows, "p").select("io", "i1", F.round("p", 6).alias("p"))


@q("ml7_9_final_scores_all_pairs")
def ml7b(spark, d):
    """The whole cascade: every scored pair filtered by ``p1``, the kept ones by boosted trees over the 50 pair features and those of competition."""
    rows, p1 = filtered(spark, d)
    kept = cut(blocking.top_candidates(p1, 3, "p1").filter("p1 >= 0.01").join(rows.select("io", "i1", "src"), ["io", "i1"]))
    rows = rows.join(features.competition(kept), ["io", "i1"])
    rows, columns = models.numeric(cut(rows), [*features.PAIR_FEATURES, *features.COMPETITION])
    known = rows.join(labelled(spark, d).select(number("s1_id").alias("i1")), "i1", "left_semi").withColumn("w", F.when(F.col("owner").isNull(), 2.0).otherwise(1.0))
    model = models.fit(known, columns, rounds=12, depth=4, weight="w", validation="val")
    return models.score(model, rows, "p").select("io", "i1", F.round("p", 6).alias("p"))


@q("ml8_importance")
def ml8(spark, d):
    rows = cut(_labelled(spark, d))
    model = models.fit(rows, FILTER_COLUMNS, rounds=8, depth=4)
    return spark.createDataFrame(models.importances(model, FILTER_COLUMNS), "feature string, importance double")


@q(
    "ml10_text_pair_folds",
    f"""WITH {TRUTH_N}, {SCORED}, own AS (SELECT io, min(i1) AS o1 FROM gn GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY block_score DESC, i1) AS rb FROM s)
    SELECT io, i1, coalesce(o1 = i1, false)::INT::DOUBLE AS y, NOT coalesce(o1 = i1, false) AND rb = 1 AS hardest FROM r LEFT JOIN own USING (io) WHERE rb <= 3 OR o1 = i1""",
)
def ml10(spark, d):
    """Positives and the negatives near the top, the first of which is the hardest."""
    rows = _candidates(spark, d)
    rows = models.labelled_pairs(rows, true_pairs(spark, d))
    keep = (F.col("rank_block") <= 3) | (F.col("y") == 1.0)
    return rows.filter(keep).select("io", "i1", "y", ((F.col("y") == 0.0) & (F.col("rank_block") == 1)).alias("hardest"))


@q(
    "ml10_text_pair_folds_both_ranks",
    f"""WITH {TRUTH_N}, {SCORED}, own AS (SELECT io, min(i1) AS o1 FROM gn GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY block_score DESC, i1) AS rb, row_number() OVER (PARTITION BY io ORDER BY tfidf_sim DESC, i1) AS rt FROM s)
    SELECT io, i1, coalesce(o1 = i1, false)::INT::DOUBLE AS y, NOT coalesce(o1 = i1, false) AND (rb = 1 OR rt = 1) AS hardest FROM r LEFT JOIN own USING (io) WHERE rb <= 3 OR rt <= 2 OR o1 = i1
    UNION ALL SELECT io, o1, 1.0::DOUBLE, false FROM own WHERE io IN (SELECT io FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.io = own.io AND s.i1 = own.o1)""",
)
def ml10b(spark, d):
    """The pairs of ``text_pairs`` without their fold, which is a seeded hash."""
    return text_pairs(spark, d).drop("fold")


@q("ml10_text_pair_folds_with_fold")
def ml10c(spark, d):
    return text_pairs(spark, d)


def text_pairs(spark, d) -> DataFrame:
    """Every true pair of a record with candidates, found or not, and the negatives near the top by keys (3) or by text (2), the first by
    either the hardest; ``fold`` follows the owner, else the record's top candidate."""
    from pyspark.sql import Window

    w = Window.partitionBy("io").orderBy(F.desc("tfidf_sim"), "i1")
    pairs = scored_pairs(spark, d)
    owners = true_pairs(spark, d).groupBy("io").agg(F.min("i1").alias("i1"))
    rows = _candidates(spark, d).withColumn("rank_text", F.row_number().over(w)).select("io", "i1", "rank_block", "rank_text")
    missed = owners.join(pairs.select("io"), "io", "left_semi").join(pairs, ["io", "i1"], "left_anti").select("io", "i1", F.lit(None).cast("int").alias("rank_block"), F.lit(None).cast("int").alias("rank_text"))
    rows = models.labelled_pairs(rows.unionByName(missed), owners, blocking.anchors(pairs))
    first = F.coalesce((F.col("rank_block") == 1) | (F.col("rank_text") == 1), F.lit(False))
    keep = (F.col("rank_block") <= 3) | (F.col("rank_text") <= 2) | (F.col("y") == 1.0)
    return rows.filter(keep).select("io", "i1", "y", ((F.col("y") == 0.0) & first).alias("hardest"), "fold")


@q("ml11_sampled_pairs")
def ml11(spark, d):
    """Pairs to train a text model on: 200 positives and 300 negatives, two thirds of these hard; a sample is what the operator is for."""
    rows = models.labelled_pairs(_candidates(spark, d), true_pairs(spark, d))
    return models.sampled_pairs(rows, 200, 300).select("io", "i1", "y")


@q("ml13_cross_fitted_text_score")
def ml13(spark, d):
    """The text score by the plug: here two plain scorers, one a fold, stand in for text models."""
    s1, o = _prepared(spark, d)
    rows = models.labelled_pairs(pruned(spark, d), true_pairs(spark, d))
    rows = rows.join(o.select("io", F.col("core").alias("text_o")), "io").join(s1.select("i1", F.col("core").alias("text_1")), "i1")
    scorers = {0: lambda a, b: [token_set_ratio(x, y) for x, y in zip(a, b)], 1: lambda a, b: [token_sort_ratio(x, y) for x, y in zip(a, b)]}
    return models.cross_fitted_text_score(rows, scorers).withColumn("ce", F.round("ce", 6))


@q("ml14_measures")
def ml14(spark, d):
    rows = cut(_labelled(spark, d))
    scored = cut(models.out_of_fold(rows, FILTER_COLUMNS, learner="logistic", rounds=40)[0])
    area = lambda m: BinaryClassificationEvaluator(rawPredictionCol="p1", labelCol="y", metricName=m).evaluate(scored)
    p = F.least(F.greatest(F.col("p1"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = scored.agg(F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("l"), F.count(F.when((F.col("p1") >= 0.5) != (F.col("y") == 1.0), 1)).alias("e")).first()
    return spark.createDataFrame([(round(area("areaUnderROC"), 6), round(area("areaUnderPR"), 6), round(loss["l"] or 0.0, 6), loss["e"])], "auc double, average_precision double, log_loss double, errors long")


@q("ml15_stacked")
def ml15(spark, d):
    """A second model on the first one's out-of-fold score and its standing."""
    rows = cut(_labelled(spark, d))
    first = cut(models.out_of_fold(rows, FILTER_COLUMNS, learner="logistic", rounds=40)[0])
    comp = features.competition(first.join(others(spark, d).select("io", "src"), "io").select("io", "i1", "src", "p1")).select("io", "i1", "q_gap", "q_2nd")
    both = cut(first.join(comp, ["io", "i1"]))
    return models.out_of_fold(both, ["p1", "q_gap", "q_2nd", "tfidf_sim"], out="stacked", learner="logistic", rounds=40)[0].select("io", "i1", F.round("stacked", 6).alias("p"))


@q("dg10_permutation_loss")
def dg10(spark, d):
    rows = cut(_labelled(spark, d))
    model = models.fit(rows, FILTER_COLUMNS, "logistic", rounds=40)
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y")
    groups = {"keys": ["block_score", "n_shared", "rank_block", "gap_block"], "text": ["tfidf_sim"], "crowding": ["n_cand_o", "n_cand_1", "rank_block_1"]}
    losses = models.permutation_loss(model, rows.select("io", "i1", "y", *FILTER_COLUMNS), groups, ev.evaluate)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(losses.items())], "columns string, auc_lost double")


@q("ml_model_round_trip")
def ml_io(spark, d):
    """A model written, read again and used."""
    from weftwork.plans.er import _scratch
    from pyspark.ml import PipelineModel

    rows = cut(_labelled(spark, d))
    path = _scratch(spark, "model")
    models.fit(rows, FILTER_COLUMNS, "logistic", rounds=20).write().overwrite().save(path)
    return models.score(PipelineModel.load(path), rows, "p").select("io", "i1", F.round("p", 6).alias("p"))
