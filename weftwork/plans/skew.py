"""Problem 5: per-key results where a handful of keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators.positions import distinct_by_key
from weftwork.plans.registry import Registry
from weftwork.session import table

REG = Registry()


def frequent_keys(keys: DataFrame, per_cent: int = 3) -> DataFrame:
    """Keys with at least ``per_cent`` % of their country's distinct (src, id, key)."""
    counts = distinct_by_key(keys.filter(F.col("key").isNotNull()), ["country", "key"], ["src", "id"])
    # one row a key is left here: the total is taken from partial sums, and the window is over keys, not rows
    totals = counts.groupBy(F.col("country").alias("of_country")).agg(F.sum("n_distinct").alias("n_country"))
    hit = counts.join(totals, F.col("country").eqNullSafe(F.col("of_country")))
    return hit.filter(F.col("n_distinct") * 100 >= F.col("n_country") * per_cent).select("country", "key")


@REG.query(
    "p5_found",
    """WITH d AS (SELECT DISTINCT country, key, src, id FROM blocking_keys WHERE key IS NOT NULL),
    k AS (SELECT country, key, count(*) AS n FROM d GROUP BY 1, 2),
    t AS (SELECT country, sum(n) AS total FROM k GROUP BY 1)
    SELECT k.country, k.key FROM k JOIN t ON k.country IS NOT DISTINCT FROM t.country WHERE n * 100 >= total * 3""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_keys(table(spark, sf_dir, "blocking_keys"))


@REG.query(
    "p5_key_counts",
    """SELECT country, key, count(*)::BIGINT AS n_rows, count(DISTINCT (src, id))::BIGINT AS n_records
    FROM blocking_keys WHERE key IS NOT NULL GROUP BY 1, 2""",
)
def p5_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "blocking_keys").filter("key IS NOT NULL")
    return distinct_by_key(rows, ["country", "key"], ["src", "id"]).withColumnRenamed("n_distinct", "n_records")


@REG.query("p5_country_counts", "SELECT country, count(*)::BIGINT AS n_rows, count(DISTINCT entity_id)::BIGINT AS n_entities FROM source1 GROUP BY 1")
def p5_country_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_by_key(table(spark, sf_dir, "source1"), ["country"], ["entity_id"]).withColumnRenamed("n_distinct", "n_entities")
