"""The cascade of classifiers: split keys that follow owners, out-of-fold filter, pruning, final model, cross-fitted text score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.session import cut


def fold_of(key: str, seed: int, folds: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("bigint")), F.lit(folds))


def labelled_pairs(pairs: DataFrame, owners: DataFrame, parents: DataFrame | None = None, val_mod: int = 10) -> DataFrame:
    """``pairs`` with ``owner``, ``y`` (1.0 where i1 is the owner), ``fold`` (0 or 1) and ``val``. Both follow the owner; without one the record's
    top blocking candidate (``parents``: io, parent), so that decoys fall where their look-alikes do, else the record itself."""
    rows = pairs.join(owners.select("io", F.col("i1").alias("owner")).dropDuplicates(["io"]), "io", "left")
    key = ["owner", "io"]
    if parents is not None:
        rows = rows.join(parents, "io", "left")
        key = ["owner", "parent", "io"]
    rows = rows.withColumn("_key", F.coalesce(*key))
    y = F.coalesce((F.col("i1") == F.col("owner")).cast("double"), F.lit(0.0))
    return rows.withColumns({"y": y, "fold": fold_of("_key", 7, 2), "val": fold_of("_key", 5, val_mod) == 0}).drop("_key", "parent")


def training_rows(rows: DataFrame, easy_every: int = 10) -> DataFrame:
    """Positives, hard negatives (first or second by either rank) and one in ``easy_every`` of the easy ones, which weighs as many. A feature of
    the sampling operator; scoring goes over all rows."""
    hard = (F.col("y") == 1.0) | (F.col("rank_combo") <= 2) | (F.col("rank_block") <= 2)
    easy = F.pmod(F.xxhash64(F.lit(11), "io", "i1"), F.lit(easy_every)) == 0
    return rows.filter(hard | easy).withColumn("weight", F.when(hard, 1.0).otherwise(float(easy_every)))


def sampled_pairs(rows: DataFrame, n_pos: int, n_neg: int, seed: int = 3) -> DataFrame:
    """``n_pos`` positives and ``n_neg`` negatives, two thirds of them each record's hardest; the same rows for the same seed."""
    order = [F.xxhash64("io", "i1", F.lit(seed)), "io", "i1"]
    hard = F.col("rank_block") == 1
    positives = rows.filter("y = 1.0").orderBy(*order).limit(n_pos)
    hardest = rows.filter((F.col("y") == 0.0) & hard).orderBy(*order).limit(2 * n_neg // 3)
    easier = rows.filter((F.col("y") == 0.0) & ~hard).orderBy(*order).limit(n_neg - 2 * n_neg // 3)
    return positives.unionByName(hardest).unionByName(easier)


def numeric(rows: DataFrame, columns: list[str], missing: float = -1.0) -> tuple[DataFrame, list[str]]:
    """Columns as doubles; one with nulls gets a sentinel and an indicator beside it, as the learner takes no missing values."""
    nullable = [c for c in columns if c in ("hn0_logdiff", "hn_min_logdiff", "ce")]
    rows = rows.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in nullable} if nullable else {})
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in columns})
    return rows, [*columns, *[f"{c}_missing" for c in nullable]]


def fit(rows: DataFrame, columns: list[str], learner: str = "gbt", rounds: int = 20, depth: int = 5, label: str = "y", weight: str | None = None, validation: str | None = None) -> PipelineModel:
    options = {"featuresCol": "features", "labelCol": label} | ({"weightCol": weight} if weight else {})
    if learner == "gbt":
        options |= {"validationIndicatorCol": validation} if validation else {}
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=1, **options)
    else:
        model = LogisticRegression(maxIter=rounds, regParam=1e-3, **options)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), model]).fit(rows)


def score(model: PipelineModel, rows: DataFrame, out: str) -> DataFrame:
    p = vector_to_array("probability")[1]
    return model.transform(rows).withColumn(out, p).drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, columns: list[str], out: str = "p1", learner: str = "gbt", rounds: int = 20, unseen: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Every row scored by the model of the other fold; rows of ``unseen`` by the mean of both."""
    models = [fit(training_rows(rows.filter(F.col("fold") == 1 - f)), columns, learner, rounds, weight="weight") for f in (0, 1)]
    scored = score(models[0], rows.filter("fold = 0"), out).unionByName(score(models[1], rows.filter("fold = 1"), out))
    if unseen is None:
        return scored, None
    both = score(models[1], score(models[0], unseen, "_a"), "_b")
    return scored, both.withColumn(out, (F.col("_a") + F.col("_b")) / 2).drop("_a", "_b")


def importances(model: PipelineModel, columns: list[str], top: int = 15) -> list[tuple[str, float]]:
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(zip(columns, map(float, weights)), key=lambda x: (-x[1], x[0]))[:top]


def cross_fitted_text_score(pairs: DataFrame, scorers: dict[int, Callable[[list[str], list[str]], list[float]]], out: str = "ce") -> DataFrame:
    """``io, i1, ce`` of pairs ``io, i1, fold, text_o, text_1``: each by the scorer of the other fold. A scorer takes two lists of texts and gives
    a list of scores; this is the plug for a text model, which runs on Arrow batches where the data are."""
    schema = T.StructType([pairs.schema["io"], pairs.schema["i1"], T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = pd.Series(float("nan"), index=pdf.index)
            for fold, part in pdf.groupby(pdf["fold"].fillna(0)):
                values[part.index] = scorers[1 - int(fold)](part["text_o"].tolist(), part["text_1"].tolist())
            yield pd.DataFrame({"io": pdf["io"], "i1": pdf["i1"], out: values})

    return pairs.select("io", "i1", "fold", "text_o", "text_1").mapInPandas(run, schema)


def permutation_loss(model: PipelineModel, rows: DataFrame, groups: dict[str, list[str]], measure: Callable[[DataFrame], float]) -> dict[str, float]:
    """How much a measure loses when a group of columns is exchanged among rows, each row taking the values of its neighbour in a seeded order."""
    rows = cut(rows)
    base = measure(score(model, rows, "p"))
    out = {}
    n = rows.count()
    for name, columns in groups.items():
        place = rows.rdd.zipWithIndex().toDF(["r", "i"]).select("i", "r.*")
        moved = place.select(((F.col("i") + n // 2 + 1) % F.lit(max(n, 1))).alias("i"), *columns)
        mixed = place.drop(*columns).join(moved, "i").drop("i")
        out[name] = base - measure(score(model, mixed, "p"))
    return out
