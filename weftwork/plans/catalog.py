"""All registries of the core library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftwork.plans import cascade, diagnostics, er, relational, skew


def registries() -> list:
    return [skew.REG, relational.REG, er.REG, diagnostics.REG, cascade.REG]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er.de7(spark, sf_dir)
