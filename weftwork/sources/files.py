"""Delimited and Parquet sources and sinks of the record-linkage tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD, check_rows: bool = True) -> DataFrame:
    """Tab-separated, header, quotes are data, every field a string, ``NA`` and ``null`` are text, an empty field is empty.
    A row with too few or too many fields fails; with ``check_rows`` so does a parse that lost or gained lines."""
    rows = spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="", lineSep="\n", mode="FAILFAST").csv(path)
    rows = rows.select([F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])
    if check_rows:
        files = len(rows.inputFiles())
        lines = spark.read.option("lineSep", "\n").text(path).count()
        if (n := rows.count()) != lines - files:
            raise ValueError(f"{path}: {n} rows parsed of {lines - files} lines")
    return rows


def write_tsv(rows: DataFrame, path: str, single: bool = False) -> None:
    """Tab-separated with header, nothing quoted, empty fields empty; one file with ``single``."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="", lineSep="\n").csv(path)


def stack_others(source2: DataFrame, source3: DataFrame) -> DataFrame:
    """Sources 2 and 3 on top of each other with ``src`` 2 or 3."""
    keep = list(RECORD.names)
    return source2.select(*keep, F.lit(2).cast("tinyint").alias("src")).unionByName(source3.select(*keep, F.lit(3).cast("tinyint").alias("src")))


def load_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(source1, others, labels); labels are None where there is no such table."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    try:
        labels = read("match_labels")
    except Exception as e:  # a missing path only
        if "PATH_NOT_FOUND" not in str(e):
            raise
        labels = None
    return read("source1").select(*RECORD.names), stack_others(read("source2"), read("source3")), labels


def truth_pairs(labels: DataFrame) -> DataFrame:
    """``s1_id, o_id`` of the comma lists; an empty or null list gives none."""
    ids = F.explode(F.split("matched_entity_ids", ","))
    return labels.filter("matched_entity_ids <> ''").select(F.col("source1_entity_id").alias("s1_id"), ids.alias("o_id")).filter("o_id <> ''")


def id_lists(s1_ids: DataFrame, pairs: DataFrame, out: str = "matched_entity_ids") -> DataFrame:
    """One row for each s1_id: its distinct o_ids in string order, joined by commas; empty without any."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("o_id")), ",").alias(out))
    return s1_ids.select("s1_id").join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(out, F.lit("")).alias(out))


def materialised(path: str, spark: SparkSession, make) -> DataFrame:
    """The table at ``path``, made and written first where there is none yet; an unfinished one does not count."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(values: dict, path: str) -> None:
    """Plain JSON, keys sorted; NaN and infinity become null."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(plain(values), f, indent=1, sort_keys=True, allow_nan=False)
