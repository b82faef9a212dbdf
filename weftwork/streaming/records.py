"""The record operators that work row by row, on a stream of records: cleaning and blocking keys without waiting for a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftwork.functions.text import add_clean, prepare
from weftwork.operators.blocking import record_keys
from weftwork.sources.files import RECORD


def record_stream(spark: SparkSession, folder: str, schema: T.StructType = RECORD) -> DataFrame:
    """Records as Parquet files arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def prepared_stream(records: DataFrame) -> DataFrame:
    return prepare(add_clean(records))


def key_stream(records: DataFrame) -> DataFrame:
    """``entity_id, country, key`` of each record as it arrives."""
    return record_keys(add_clean(records), "entity_id")
