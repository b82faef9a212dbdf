"""Dictionaries between scripts, learned from matched pairs, and their use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import INDIC, script_words


def _supported(counts: DataFrame, min_count: int, min_share: float) -> DataFrame:
    """``src_tok, dst_tok``: the commonest partner of each word (ties by the partner), with enough support and share."""
    w = Window.partitionBy("src_tok")
    ranked = counts.withColumns({"n": F.row_number().over(w.orderBy(F.desc("count"), "dst_tok")), "total": F.sum("count").over(w)})
    return ranked.filter((F.col("n") == 1) & (F.col("count") >= min_count) & (F.col("count") >= F.col("total") * min_share)).select("src_tok", "dst_tok")


def _matched(s1: DataFrame, others: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    a = s1.select(F.col("entity_id").alias("s1_id"), F.col(column).alias("x1"))
    b = others.select(F.col("entity_id").alias("o_id"), F.col(column).alias("x2"))
    return pairs.join(a, "s1_id").join(b, "o_id").filter(F.col("x2").rlike(INDIC))


def learn_words(s1: DataFrame, others: DataFrame, pairs: DataFrame, min_count: int = 2, min_share: float = 0.5) -> DataFrame:
    """Words of Indic names against the words at the same place of the matched name, where both have as many words."""
    m = _matched(s1, others, pairs, "business_name").select(script_words(F.col("x1")).alias("w1"), script_words(F.col("x2")).alias("w2")).filter("size(w1) = size(w2)")
    met = m.select(F.explode(F.arrays_zip("w1", "w2")).alias("z")).select(F.col("z.w2").alias("src_tok"), F.col("z.w1").alias("dst_tok"))
    met = met.filter(F.col("src_tok").rlike(INDIC) & ~F.col("dst_tok").rlike(INDIC))
    return _supported(met.groupBy("src_tok", "dst_tok").count(), min_count, min_share)


def strip(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _parts(column: str):
    return F.transform(F.split(column, ","), strip)


def learn_address_parts(s1: DataFrame, others: DataFrame, pairs: DataFrame, min_count: int = 5, min_share: float = 0.6) -> DataFrame:
    """Indic parts of addresses against the last part of the matched address."""
    m = _matched(s1, others, pairs, "business_address").select(F.lower(F.element_at(_parts("x1"), -1)).alias("dst_tok"), F.explode(_parts("x2")).alias("part"))
    met = m.select(F.lower("part").alias("src_tok"), "dst_tok").filter(F.col("src_tok").rlike(INDIC))
    return _supported(met.groupBy("src_tok", "dst_tok").count(), min_count, min_share)


def _replace(records: DataFrame, key: str, pieces: DataFrame, dictionary: DataFrame, glue: str, out: str) -> DataFrame:
    """Pieces ``_k`` (id), ``_i``, ``_look``, ``_keep``: looked up, put together in order."""
    d = dictionary.select(F.col("src_tok").alias("_look"), "dst_tok")
    said = pieces.join(d, "_look", "left").withColumn("_w", F.coalesce("dst_tok", "_keep"))
    whole = said.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_i", "_w"))).alias("_a"))
    whole = whole.select(F.col("_k").alias(key), F.array_join(F.transform("_a", lambda x: x["_w"]), glue).alias(out))
    return records.join(whole, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def transliterate_names(records: DataFrame, dictionary: DataFrame, key: str = "entity_id", column: str = "business_name", out: str = "name_lat") -> DataFrame:
    """The words of names, lower-case and without punctuation, known Indic ones in Latin and unknown ones kept; ``key`` is unique."""
    pieces = records.select(F.col(key).alias("_k"), F.posexplode(script_words(F.coalesce(column, F.lit("")))).alias("_i", "_keep")).withColumn("_look", F.col("_keep"))
    return _replace(records, key, pieces, dictionary, " ", out)


def transliterate_addresses(records: DataFrame, dictionary: DataFrame, key: str = "entity_id", column: str = "business_address", out: str = "addr_lat") -> DataFrame:
    """Addresses whose known Indic parts are in Latin, parts joined by ``", "``."""
    pieces = records.select(F.col(key).alias("_k"), F.posexplode(F.transform(F.split(F.coalesce(column, F.lit("")), ","), strip)).alias("_i", "_keep")).withColumn("_look", F.lower("_keep"))
    return _replace(records, key, pieces, dictionary, ", ", out)
