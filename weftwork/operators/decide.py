"""One owner a record, thresholds, and the measures of a matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def best_candidates(scored: DataFrame, score: str = "p") -> DataFrame:
    """The candidate of every record with the highest score; ties by the reference id, no score last."""
    w = Window.partitionBy("io").orderBy(F.desc_nulls_last(score), "i1")
    return scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def assign(scored: DataFrame, tau: float, score: str = "p") -> DataFrame:
    """``io, i1``: the best candidate of each record, kept at ``score >= tau``."""
    return best_candidates(scored, score).filter(F.col(score) >= tau).select("io", "i1")


def assign_two_thresholds(scored: DataFrame, empty_address: DataFrame, tau: float, tau_empty: float) -> DataFrame:
    """The winner is chosen first; records in ``empty_address`` (io) then have a threshold of their own."""
    flag = empty_address.select("io").distinct().withColumn("_empty", F.lit(True))
    rows = best_candidates(scored).join(flag, "io", "left")
    return rows.filter(F.col("p") >= F.when(F.col("_empty"), tau_empty).otherwise(tau)).select("io", "i1")


def f_half(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of one reference record: 1 where nothing is there to find and nothing was found, 0 without a hit."""
    precision, recall = F.try_divide(tp, n_pred), F.try_divide(tp, n_true)
    value = F.try_divide(1.25 * precision * recall, 0.25 * precision + recall)
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(tp == 0, 0.0).otherwise(value)


def per_entity(ids: DataFrame, predicted: DataFrame, truth: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``s1_id, tp, n_pred, n_true, f`` for every row of ``ids`` (s1_id); pairs of other ids don't count, repeated pairs count once."""
    p = predicted.select("s1_id", "o_id", *(extra or [])).distinct().withColumn("_p", F.lit(1))
    t = truth.select("s1_id", "o_id").distinct().withColumn("_t", F.lit(1))
    counts = p.join(t, ["s1_id", "o_id"], "full").groupBy("s1_id").agg(F.count(F.when(F.col("_p").isNotNull() & F.col("_t").isNotNull(), 1)).alias("tp"), F.count("_p").alias("n_pred"), F.count("_t").alias("n_true"))
    rows = ids.select("s1_id").join(counts, "s1_id", "left").fillna(0, ["tp", "n_pred", "n_true"])
    return rows.withColumn("f", f_half(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro_f_half(ids: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return per_entity(ids, predicted, truth).agg(F.avg("f").alias("macro_f05"))


def evaluate(ids: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: macro and micro measures, empty cases, counts and averages."""
    e = per_entity(ids, predicted, truth)
    has = lambda cond: F.count(F.when(cond, 1))
    tp, npred, ntrue = F.sum("tp"), F.sum("n_pred"), F.sum("n_true")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return e.agg(
        F.count(F.lit(1)).alias("entities"), F.avg("f").alias("macro_f05"),
        F.avg(zero(F.try_divide("tp", "n_pred"))).alias("macro_precision"), F.avg(zero(F.try_divide("tp", "n_true"))).alias("macro_recall"),
        F.try_divide(tp, npred).alias("micro_precision"), F.try_divide(tp, ntrue).alias("micro_recall"),
        has((F.col("n_pred") == 0) & (F.col("n_true") == 0)).alias("true_empty"), has((F.col("n_pred") > 0) & (F.col("n_true") == 0)).alias("false_positive_empty"),
        has((F.col("n_pred") == 0) & (F.col("n_true") > 0)).alias("missed_all"), has(F.col("n_true") == 1).alias("truth_1"), has(F.col("n_true") == 2).alias("truth_2"),
        has(F.col("n_true") >= 3).alias("truth_3_up"), F.avg("n_pred").alias("avg_predicted"), F.avg("n_true").alias("avg_true"),
    )


def sweep(ids: DataFrame, scored: DataFrame, truth: DataFrame, taus: list[float]) -> DataFrame:
    """``tau, macro_f05, n_pred, precision, recall`` for each threshold, in one job. ``scored`` is ``s1_id, o_id, p`` of the best candidates. For
    an entity only the counts at each threshold matter, so the pairs fold before the thresholds meet the entities."""
    spark: SparkSession = ids.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(t),) for t in taus], "tau double"))  # one row a threshold
    n_true = truth.select("s1_id", "o_id").distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    hit = scored.join(truth.select("s1_id", "o_id").distinct().withColumn("_t", F.lit(1)), ["s1_id", "o_id"], "left")
    at = hit.join(grid, F.col("p") >= F.col("tau")).groupBy("s1_id", "tau").agg(F.count(F.lit(1)).alias("n_pred"), F.count("_t").alias("tp"))
    every = ids.select("s1_id").join(n_true, "s1_id", "left").crossJoin(grid)
    rows = every.join(at, ["s1_id", "tau"], "left").fillna(0, ["n_true", "n_pred", "tp"])
    rows = rows.withColumn("f", f_half(F.col("tp"), F.col("n_pred"), F.col("n_true")))
    return rows.groupBy("tau").agg(F.avg("f").alias("macro_f05"), F.sum("n_pred").alias("n_pred"), F.try_divide(F.sum("tp"), F.sum("n_pred")).alias("precision"), F.try_divide(F.sum("tp"), F.sum("n_true")).alias("recall"))


def with_duplicates(predicted: DataFrame, unowned: DataFrame) -> DataFrame:
    """A denser test set: predictions of records without owner a second time, under ids that end in ``_dup``."""
    again = predicted.join(unowned.select("o_id"), "o_id", "left_semi").select("s1_id", F.concat("o_id", F.lit("_dup")).alias("o_id"))
    return predicted.select("s1_id", "o_id").unionByName(again)
