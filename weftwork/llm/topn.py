"""Top N items of every group by a global sort (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators.positions import with_positions


def top_by_score(rows: DataFrame, group: str, item: str, scores: list[str], n: int) -> DataFrame:
    """``group, item, <scores>, position``: the first ``n`` different items of each group by the scores
    descending (null and NaN last and equal to each other), then the item ascending; an item counts by its
    best row. Rows with a null group or item belong to nothing and are left out. Identical rows count once.

    Duplicates fold into their best row by (group, item), which no hot group can skew. What is left is sorted
    globally by (group, scores, item) into range partitions, so a group of a third of all rows spans many of
    them; per-partition counts, prefix-summed, give exact positions.
    """
    clean = [F.when(~F.isnan(c), F.col(c).cast("double")).alias(c) for c in scores]
    # within a struct null sorts first, so the maximum takes null and NaN last
    best = (
        rows.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
        .select(group, item, F.struct(*clean).alias("_best"))
        .groupBy(group, item)
        .agg(F.max("_best").alias("_best"))
        .select(group, item, "_best.*")
    )
    order = [F.col(c).desc_nulls_last() for c in scores] + [F.col(item).asc()]
    return with_positions(best, [group], order, "position", keep=n)
