"""Queries and SQL of the training-data operators; every one runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.addresses import building_classes, same_building
from weftwork.llm.linkage import link_records, linked
from weftwork.llm.lookalikes import LOOK_ALIKES, canonical_records, same_on_screen, screen_classes
from weftwork.llm.mixing import mix
from weftwork.llm.pii import find_personal, replace_personal
from weftwork.llm.splits import balanced_splits, bound_groups
from weftwork.llm.tokenizer import count_tokens, encode_corpus
from weftwork.llm.topn import top_by_score
from weftwork.llm.variants import name_stars, variant_pairs
from weftwork.plans.registry import Registry
from weftwork.session import table

REG = Registry()

# ---- 1: same postal address written differently


@REG.query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_building(table(spark, sf_dir, "source1"), table(spark, sf_dir, "source3"), table(spark, sf_dir, "match_labels"))


@REG.query("p1_classes")
def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record with its building's class and number of links."""
    return building_classes(table(spark, sf_dir, "source1"), table(spark, sf_dir, "source3"))


# ---- 2: visually identical text


#: The same reading in SQL, as far as the characters of these tables go.
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_LOOKS = "".join(LOOK_ALIKES)
_MODELS = "".join(LOOK_ALIKES.values())


def _reading_sql(col: str) -> str:
    x = rf"regexp_replace({col}, '[\x{{00AD}}\x{{034F}}\x{{061C}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FE00}}-\x{{FE0F}}\x{{FEFF}}]', '', 'g')"
    x = rf"regexp_replace({x}, '[\t\n\r\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g')"
    x = f"replace(replace(translate(translate({x}, '{_FULL}', '{_PLAIN}'), '{_LOOKS}', '{_MODELS}'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    return f"nfc_normalize({x})"


@REG.query(
    "p2_found",
    f"""WITH r AS (SELECT DISTINCT entity_id, country, business_name AS n, business_address AS a, trim({_reading_sql('business_name')}, ' ') AS rn, trim({_reading_sql('business_address')}, ' ') AS ra FROM source3 WHERE business_name IS NOT NULL)
    SELECT DISTINCT x.entity_id AS id_a, y.entity_id AS id_b FROM r x JOIN r y ON x.country IS NOT DISTINCT FROM y.country AND x.rn = y.rn AND x.ra = y.ra AND x.entity_id < y.entity_id AND (x.n <> y.n OR x.a <> y.a)
    WHERE upper(x.ra) NOT IN ('', 'NA', 'N/A', 'NULL')""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_on_screen(table(spark, sf_dir, "source3"))


@REG.query("p2_consistent", f"SELECT DISTINCT entity_id, country, business_name, business_address, {_reading_sql('business_name')} AS same_name, {_reading_sql('business_address')} AS same_address FROM source3")
def p2_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_records(table(spark, sf_dir, "source3"))


@REG.query("p2_classes")
def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record with the class of its reading."""
    return screen_classes(table(spark, sf_dir, "source3"))


# ---- 3: matching entities across sources without keys


@REG.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "source1"), table(spark, sf_dir, "source3"), table(spark, sf_dir, "match_labels"))


@REG.query("p3_links")
def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best reference record of each record that has a candidate, with a confidence."""
    rows = link_records(table(spark, sf_dir, "source1"), table(spark, sf_dir, "source3"))
    return rows.select("s1_id", "s3_id", "ties", F.round("confidence", 6).alias("confidence"))


# ---- 4: variant spellings of names


@REG.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(table(spark, sf_dir, "source1"), table(spark, sf_dir, "source3"), table(spark, sf_dir, "match_labels"))


@REG.query("p4_stars")
def p4_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a different name of either side with its star."""
    return name_stars(table(spark, sf_dir, "source1"), table(spark, sf_dir, "source3")).select("country", "name", "star", "referenced")


# ---- 6: top N items within every group


@REG.query(
    "p6_found",
    """WITH r AS (SELECT io, i1, CASE WHEN isnan(p) THEN NULL ELSE p END AS p, block_score AS b FROM candidate_pairs WHERE io IS NOT NULL AND i1 IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY io, i1 ORDER BY p DESC NULLS LAST, b DESC NULLS LAST) AS k FROM r),
    o AS (SELECT io, i1, row_number() OVER (PARTITION BY io ORDER BY p DESC NULLS LAST, b DESC NULLS LAST, i1) AS n FROM f WHERE k = 1)
    SELECT io, i1 FROM o WHERE n <= 3""",
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_by_score(table(spark, sf_dir, "candidate_pairs"), "io", "i1", ["p", "block_score"], 3).select("io", "i1")


# ---- 7: splits that keep related records together


@REG.query(
    "p7_found",
    """WITH RECURSIVE e AS (SELECT DISTINCT io, i1 FROM candidate_pairs WHERE p >= 0.5 AND NOT isnan(p) AND io IS NOT NULL AND i1 IS NOT NULL),
    m AS (SELECT io, min(i1) AS m FROM e GROUP BY io HAVING count(*) > 1),
    l AS (SELECT DISTINCT e.i1 AS a, m.m AS b FROM e JOIN m USING (io) WHERE e.i1 <> m.m),
    s AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    w(v, r) AS (SELECT a, a FROM s UNION SELECT s.b, w.r FROM w JOIN s ON s.a = w.v WHERE w.r < s.b)
    SELECT v AS i1, min(r) AS group_i1 FROM w GROUP BY v""",
)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound_groups(table(spark, sf_dir, "candidate_pairs")).select("i1", "group_i1")


@REG.query("p7_splits")
def p7_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_splits(table(spark, sf_dir, "source1"), table(spark, sf_dir, "candidate_pairs"))


@REG.query("p7_split_shares")
def p7_split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = balanced_splits(table(spark, sf_dir, "source1"), table(spark, sf_dir, "candidate_pairs"))
    total = rows.agg(F.sum("weight").alias("all_weight"))
    by = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_entities"), F.sum("weight").alias("n_records"))
    return by.crossJoin(F.broadcast(total)).select("split", "n_entities", "n_records", (F.col("n_records") / F.col("all_weight")).alias("share"))


# ---- 8: encoding with a public tokenizer


@REG.query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


@REG.query("p8_counts")
def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])


# ---- 9: mixing sources to target weights


def _mixed(spark: SparkSession, sf_dir: str, by: str) -> tuple[DataFrame, DataFrame]:
    counted = count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return mix(counted, table(spark, sf_dir, "mix_targets"), by=by)


def _with_shares(rows: DataFrame, report: DataFrame) -> DataFrame:
    shares = report.select(F.col("source").alias("s"), "target_share", "reached_share")  # one row a target
    return rows.join(F.broadcast(shares), F.col("source") == F.col("s")).drop("s")


@REG.query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy of a document in the mix, with the share that its source was to have and has reached."""
    return _with_shares(*_mixed(spark, sf_dir, "targets"))


@REG.query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, "targets")[1]


@REG.query("p9_temperature")
def p9_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix by one common exponent, of the entropy of the targets."""
    return _with_shares(*_mixed(spark, sf_dir, "temperature"))


@REG.query("p9_temperature_shares")
def p9_temperature_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, "temperature")[1]


# ---- 10: personal information inside free text


@REG.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents")).select("doc_id", "kind", "start_pos").distinct()


@REG.query("p10_replaced")
def p10_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal(table(spark, sf_dir, "documents"))
