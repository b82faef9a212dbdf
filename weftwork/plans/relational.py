"""Relational operators of the inventory, each over whole tables with the SQL that checks it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.operators.cells import Postings, bundled, opened
from weftwork.operators.positions import with_positions
from weftwork.plans.registry import Registry
from weftwork.session import cut, shuffle_width, table

REG = Registry()
q = REG.query
#: Keys of a block of the reference, and of a part of the records beside it, at most; and of a part at least, where fewer would leave tasks idle.
BLOCK_KEYS, PART_KEYS, LEAST_KEYS = 1 << 20, 1 << 15, 1 << 12


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``io, i1`` once each with their best scores; NaN counts as no score."""
    c = table(spark, sf_dir, "candidate_pairs")
    return c.groupBy("io", "i1").agg(
        F.max(F.when(~F.isnan("p"), F.col("p"))).alias("p"), F.max("block_score").alias("block_score"), F.max("n_shared").alias("n_shared"), F.max("tfidf_sim").alias("tfidf_sim"))


SCORED = """s AS (SELECT io, i1, max(CASE WHEN isnan(p) THEN NULL ELSE p END) AS p, max(block_score) AS block_score,
max(n_shared) AS n_shared, max(tfidf_sim) AS tfidf_sim FROM candidate_pairs GROUP BY io, i1)"""


def others(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["entity_id", "business_name", "business_address", "country"]
    s2, s3 = (table(spark, sf_dir, t).select(*keep) for t in ("source2", "source3"))
    both = s2.withColumn("src", F.lit(2)).unionByName(s3.withColumn("src", F.lit(3))).distinct()
    return both.withColumn("io", F.regexp_extract("entity_id", r"-(\d+)$", 1).cast("bigint"))


OTHERS = """o AS (SELECT DISTINCT entity_id, business_name, business_address, country, src, CAST(regexp_extract(entity_id, '-([0-9]+)$', 1) AS BIGINT) AS io FROM
(SELECT entity_id, business_name, business_address, country, 2 AS src FROM source2 UNION ALL SELECT entity_id, business_name, business_address, country, 3 FROM source3))"""


# ---- projections and filters


@q("prj1_select_rename_drop", "SELECT o_orderkey AS order_id, o_totalprice * 2 AS doubled, o_orderstatus FROM orders")
def prj1(spark, d):
    t = table(spark, d, "orders").withColumn("doubled", F.col("o_totalprice") * 2).withColumnRenamed("o_orderkey", "order_id")
    return t.drop("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")


@q("prj2_case", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS band FROM lineitem""")
def prj2(spark, d):
    band = F.when(F.col("l_quantity") < 10, "few").when(F.col("l_quantity") < 30, "some").otherwise("many")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", band.alias("band"))


@q("prj3_coalesce", "SELECT doc_id, coalesce(source, lang, 'none') AS origin, coalesce(n_chars, 0) AS n_chars FROM documents")
def prj3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("source", "lang", F.lit("none")).alias("origin"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


@q(
    "prj4_predicates",
    """SELECT doc_id, lang FROM documents WHERE (lang IN ('en', 'de') AND n_chars BETWEEN 100 AND 2000) OR (source IS NULL AND NOT (n_chars IS NOT NULL AND n_chars < 0))""",
)
def prj4(spark, d):
    t = table(spark, d, "documents")
    keep = (F.col("lang").isin("en", "de") & F.col("n_chars").between(100, 2000)) | (F.col("source").isNull() & ~(F.col("n_chars").isNotNull() & (F.col("n_chars") < 0)))
    return t.filter(keep).select("doc_id", "lang")


@q("prj5_member_of_column", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def prj5(spark, d):
    chosen = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").join(chosen, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@q("prj6_casts", "SELECT io, i1, CAST(p >= 0.5 AS INTEGER)::DOUBLE AS strong, n_shared::DOUBLE AS n_shared FROM candidate_pairs WHERE p IS NOT NULL AND NOT isnan(p)")
def prj6(spark, d):
    t = table(spark, d, "candidate_pairs").filter(F.col("p").isNotNull() & ~F.isnan("p"))
    return t.select("io", "i1", (F.col("p") >= 0.5).cast("double").alias("strong"), F.col("n_shared").cast("double").alias("n_shared"))


@q("prj7_word_positions", "SELECT p_partkey, unnest(range(len(string_split(p_name, ' '))))::INTEGER AS pos, unnest(string_split(p_name, ' ')) AS word FROM part")
def prj7(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


@q("prj8_column_by_key", "SELECT c.c_custkey, c.c_name, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def prj8(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(n, "c_nationkey").select("c_custkey", "c_name", "n_name")


# ---- joins


@q("jn1_attach_records", f"WITH {SCORED}, {OTHERS} SELECT s.io, s.i1, o.country, o.src, s.p FROM s JOIN o ON s.io = o.io")
def jn1(spark, d):
    return scored_pairs(spark, d).join(others(spark, d).select("io", "country", "src"), "io").select("io", "i1", "country", "src", "p")


@q(
    "jn2_inverted_index",
    """WITH k AS (SELECT DISTINCT id, src, country, key FROM blocking_keys WHERE key IS NOT NULL),
    f AS (SELECT country, key FROM k WHERE src = 1 GROUP BY 1, 2 HAVING count(*) <= 20)
    SELECT a.src, a.id AS io, b.id AS i1, count(*)::BIGINT AS n_shared FROM k a JOIN f USING (country, key) JOIN k b ON b.src = 1 AND b.country = a.country AND b.key = a.key
    WHERE a.src > 1 GROUP BY 1, 2, 3""",
)
def jn2(spark, d):
    k = table(spark, d, "blocking_keys").filter("key IS NOT NULL").select("id", "src", "country", "key").distinct()
    s1 = k.filter("src = 1").select(F.col("id").alias("i1"), "country", "key")
    rare = s1.groupBy("country", "key").count().filter("count <= 20").select("country", "key")
    postings = s1.join(rare, ["country", "key"])
    met = k.filter("src > 1").join(postings, ["country", "key"])
    return met.groupBy("src", F.col("id").alias("io"), "i1").agg(F.count(F.lit(1)).alias("n_shared"))


@q(
    "jn2_all_keys",
    """WITH k AS (SELECT DISTINCT id, src, country, key FROM blocking_keys WHERE key IS NOT NULL)
    SELECT a.src, a.id AS io, b.id AS i1, count(*)::BIGINT AS n_shared FROM k a JOIN k b ON b.src = 1 AND b.country = a.country AND b.key = a.key WHERE a.src > 1 GROUP BY 1, 2, 3""",
)
def jn2_all(spark, d):
    """Every pair that shares a key, common keys included. The pairs grow with the square of the input, so none is shuffled: a key of a record
    is shuffled once, into blocks of the reference and parts of the others, each is stored once as a row, and a task reads one of either."""
    k = table(spark, d, "blocking_keys").filter("key IS NOT NULL AND country IS NOT NULL")
    kinds = {f.name: f.dataType for f in k.schema.fields}
    k = k.select("src", "id", F.concat(F.length("country").cast("string"), F.lit("|"), "country", "key").alias("key"))
    keys = k.agg(F.count(F.when(F.col("src") == 1, 1)).alias("n"), F.count(F.when(F.col("src") > 1, 1)).alias("m")).first()
    blocks = max(1, math.ceil(keys["n"] / BLOCK_KEYS))
    parts = max(1, math.ceil(keys["m"] / PART_KEYS), min(math.ceil(2 * shuffle_width(spark) / blocks), math.ceil(keys["m"] / LEAST_KEYS)))
    reference = cut(bundled(k.filter("src = 1"), ["id"], "key", blocks)).select(F.col("blob").alias("reference"))
    asking = cut(bundled(k.filter("src > 1"), ["src", "id"], "key", parts))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(batch.column("reference"), batch.column("blob")):
                yield from met(opened(one), opened(other))

    def met(reference, asking) -> Iterator[pa.RecordBatch]:
        ids, (table, row, code, said) = reference[0].column("id").combine_chunks(), asking
        src, io = table.column("src").combine_chunks(), table.column("id").combine_chunks()
        postings = Postings(reference[2], reference[1].astype(np.int32), len(reference[3]))
        known = np.asarray(pc.index_in(said, value_set=reference[3]).fill_null(-1))[code]
        row, terms = row[known >= 0], known[known >= 0].tolist()
        bounds = np.searchsorted(row, np.arange(len(io) + 1)).tolist()
        counts = np.zeros(len(ids), np.int32)
        asked, items, shared, n = [], [], [], 0
        for i, (x, y) in enumerate(zip(bounds, bounds[1:])):
            if x < y:
                postings.add(counts, terms[x:y])
                met = np.flatnonzero(counts)
                asked.append(np.full(len(met), i))
                items.append(met)
                shared.append(counts[met].astype(np.int64))
                counts.fill(0)
                n += len(met)
            if asked and (n >= 1 << 18 or i + 1 == len(io)):
                at = pa.array(np.concatenate(asked))
                yield pa.RecordBatch.from_arrays([src.take(at), io.take(at), ids.take(pa.array(np.concatenate(items))), pa.array(np.concatenate(shared))], names=["src", "io", "i1", "n_shared"])
                asked, items, shared, n = [], [], [], 0

    schema = T.StructType([T.StructField("src", kinds["src"]), T.StructField("io", kinds["id"]), T.StructField("i1", kinds["id"]), T.StructField("n_shared", T.LongType())])
    return asking.join(reference.hint("shuffle_replicate_nl"), how="cross").mapInArrow(answer, schema)


@q("jn3_dictionary_lookup", "SELECT c_custkey, coalesce(n_name, c_mktsegment) AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 2")
def jn3(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", "c_mktsegment").alias("label"))


@q("jn4_left_default", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def jn4(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@q(
    "jn5_full_outer_merge",
    """WITH a AS (SELECT io, i1, max(block_score) AS block_score FROM candidate_pairs WHERE block_score > 20 GROUP BY 1, 2), b AS (SELECT io, i1, max(tfidf_sim) AS tfidf_sim FROM candidate_pairs WHERE tfidf_sim > 0.4 GROUP BY 1, 2)
    SELECT io, i1, coalesce(block_score, 0) AS block_score, coalesce(tfidf_sim, 0) AS tfidf_sim FROM a FULL JOIN b USING (io, i1)""",
)
def jn5(spark, d):
    c = table(spark, d, "candidate_pairs")
    a = c.filter("block_score > 20").groupBy("io", "i1").agg(F.max("block_score").alias("block_score"))
    b = c.filter("tfidf_sim > 0.4").groupBy("io", "i1").agg(F.max("tfidf_sim").alias("tfidf_sim"))
    return a.join(b, ["io", "i1"], "full").select("io", "i1", F.coalesce("block_score", F.lit(0.0)).alias("block_score"), F.coalesce("tfidf_sim", F.lit(0.0)).alias("tfidf_sim"))


@q("jn6_left_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def jn6(spark, d):
    big = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey")


@q("jn7_left_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def jn7(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@q("jn8_unordered_pairs", "SELECT p_partkey, a || '_' || b AS pair FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS a FROM part) JOIN (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS b FROM part) USING (p_partkey) WHERE a < b")
def jn8(spark, d):
    words = F.array_distinct(F.split("p_name", " "))
    each = F.flatten(F.transform(words, lambda a: F.transform(F.filter(words, lambda b: b > a), lambda b: F.concat(a, F.lit("_"), b))))
    return table(spark, d, "part").select("p_partkey", F.explode(each).alias("pair"))


@q("jn9_neighbours", "SELECT entity_id, w || '_' || nxt AS bigram FROM (SELECT entity_id, w, lead(w) OVER (PARTITION BY entity_id ORDER BY pos) AS nxt FROM (SELECT entity_id, unnest(string_split(business_address, ' ')) AS w, unnest(range(len(string_split(business_address, ' ')))) AS pos FROM source1)) WHERE nxt IS NOT NULL")
def jn9(spark, d):
    words = F.split("business_address", " ")
    at = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "source1").select("entity_id", F.explode(F.transform(at, lambda i: F.concat(F.element_at(words, i), F.lit("_"), F.element_at(words, i + 1)))).alias("bigram"))


@q("jn10_product_in_record", "SELECT entity_id, a || '@' || b AS key FROM (SELECT entity_id, unnest(list_distinct(string_split(business_name, ' '))) AS a FROM source1) JOIN (SELECT entity_id, unnest(list_distinct(string_split(business_address, ' '))) AS b FROM source1) USING (entity_id)")
def jn10(spark, d):
    a, b = F.array_distinct(F.split("business_name", " ")), F.array_distinct(F.split("business_address", " "))
    both = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit("@"), y))))
    return table(spark, d, "source1").select("entity_id", F.explode(both).alias("key"))


@q("jn11_co_claimants", f"WITH {SCORED}, b AS (SELECT io, i1, p FROM s WHERE p >= 0.9) SELECT x.i1, x.io, y.io AS io2 FROM b x JOIN b y ON x.i1 = y.i1 AND x.io <> y.io")
def jn11(spark, d):
    b = scored_pairs(spark, d).filter("p >= 0.9").select("io", "i1")
    return b.join(b.withColumnRenamed("io", "io2"), "i1").filter("io <> io2").select("i1", "io", "io2")


@q("jn12_pair_merge_join", f"WITH {SCORED}, c AS (SELECT io, i1, count(*) AS n_rows FROM candidate_pairs GROUP BY 1, 2) SELECT io, i1, p, n_rows::BIGINT AS n_rows FROM s JOIN c USING (io, i1)")
def jn12(spark, d):
    n = table(spark, d, "candidate_pairs").groupBy("io", "i1").agg(F.count(F.lit(1)).alias("n_rows"))
    return scored_pairs(spark, d).join(n, ["io", "i1"]).select("io", "i1", "p", "n_rows")


@q(
    "jn14_several_keys",
    """WITH f AS (SELECT country, business_name, count(*) AS n FROM source1 GROUP BY 1, 2) SELECT entity_id, n::BIGINT AS name_freq FROM source1 JOIN f USING (country, business_name)""",
)
def jn14(spark, d):
    s = table(spark, d, "source1")
    f = s.groupBy("country", "business_name").agg(F.count(F.lit(1)).alias("name_freq"))
    return s.join(f, ["country", "business_name"]).select("entity_id", "name_freq")


# ---- aggregates


@q("ag1_count", "SELECT country, count(*)::BIGINT AS n FROM source3 GROUP BY 1")
def ag1(spark, d):
    return table(spark, d, "source3").groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@q("ag2_sum_per_pair", "SELECT l_partkey, l_suppkey, round(sum(l_quantity), 6) AS qty, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def ag2(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum("l_quantity"), 6).alias("qty"), F.count(F.lit(1)).alias("n"))


@q("ag3_max_min", "SELECT l_suppkey, max(l_extendedprice) AS hi, min(l_extendedprice) AS lo FROM lineitem GROUP BY 1")
def ag3(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("hi"), F.min("l_extendedprice").alias("lo"))


@q("ag4_mean_and_share", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_qty, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1")
def ag4(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean_qty"), F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("share"))


@q("ag5_median_percentiles", "SELECT l_linestatus, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1")
def ag5(spark, d):
    at = lambda x: F.round(F.percentile("l_extendedprice", F.lit(x)), 4)
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.median("l_extendedprice"), 4).alias("med"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@q("ag6_count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey)::BIGINT AS n FROM orders GROUP BY 1")
def ag6(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("n"))


@q("ag7_any_all", "SELECT o_custkey, bool_or(o_totalprice > 300000) AS any_big, bool_and(o_totalprice > 50000) AS all_mid FROM orders GROUP BY 1")
def ag7(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 300000).alias("any_big"), F.bool_and(F.col("o_totalprice") > 50000).alias("all_mid"))


@q("ag8_ordered_strings", "SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) AS flags FROM lineitem GROUP BY 1")
def ag8(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["l_returnflag"]), "").alias("flags"))


@q("ag9_distinct_sorted_strings", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def ag9(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@q("ag10_first_per_group", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY p DESC NULLS LAST, i1) AS n FROM s) SELECT io, i1, p FROM r WHERE n = 1")
def ag10(spark, d):
    w = Window.partitionBy("io").orderBy(F.desc_nulls_last("p"), "i1")
    return scored_pairs(spark, d).withColumn("n", F.row_number().over(w)).filter("n = 1").select("io", "i1", "p")


@q("ag11_top_k_and_second", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY block_score DESC, i1) AS n FROM s) SELECT io, max(CASE WHEN n = 2 THEN block_score END) AS second, count(CASE WHEN n <= 3 THEN 1 END)::BIGINT AS kept FROM r GROUP BY io")
def ag11(spark, d):
    r = scored_pairs(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("io").orderBy(F.desc("block_score"), "i1")))
    return r.groupBy("io").agg(F.max(F.when(F.col("n") == 2, F.col("block_score"))).alias("second"), F.count(F.when(F.col("n") <= 3, 1)).alias("kept"))


@q("ag12_share_of_total", "SELECT country, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM source3 GROUP BY 1")
def ag12(spark, d):
    t = table(spark, d, "source3")
    by, whole = t.groupBy("country").agg(F.count(F.lit(1)).alias("n")), t.agg(F.count(F.lit(1)).alias("whole"))
    return by.crossJoin(F.broadcast(whole)).select("country", "n", F.round(F.try_divide("n", "whole"), 9).alias("share"))


@q("ag13_whole_table", "SELECT count(*)::BIGINT AS height, count_if(source IS NULL)::BIGINT AS null_source, round(avg(n_chars), 6) AS mean_chars, sum(n_chars)::BIGINT AS chars FROM documents")
def ag13(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("height"), F.count_if(F.col("source").isNull()).alias("null_source"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.sum("n_chars").alias("chars"))


@q("ag14_distinct", "SELECT DISTINCT country, key FROM blocking_keys")
def ag14(spark, d):
    return table(spark, d, "blocking_keys").select("country", "key").distinct()


@q("ag14_first_of_key", "SELECT entity_id, business_name FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY loaded_at, business_name) AS n FROM source3) WHERE n = 1")
def ag14b(spark, d):
    w = Window.partitionBy("entity_id").orderBy("loaded_at", "business_name")
    return table(spark, d, "source3").withColumn("n", F.row_number().over(w)).filter("n = 1").select("entity_id", "business_name")


@q("ag15_buckets", "SELECT CASE WHEN n >= 5 THEN '5+' ELSE n::VARCHAR END AS bucket, count(*)::BIGINT AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def ag15(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.when(F.col("n") >= 5, "5+").otherwise(F.col("n").cast("string")).alias("bucket")).agg(F.count(F.lit(1)).alias("orders"))


# ---- windows


@q("wn1_position", "SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_extendedprice) - 1 AS pos FROM lineitem")
def wn1(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (F.row_number().over(w) - 1).cast("bigint").alias("pos"))


@q("wn2_running_sum", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 4) AS run FROM orders")
def wn2(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 4).alias("run"))


@q("wn4_rank_in_record", f"WITH {SCORED} SELECT io, i1, row_number() OVER (PARTITION BY io ORDER BY block_score DESC, i1) AS rank_block FROM s")
def wn4(spark, d):
    return scored_pairs(spark, d).select("io", "i1", F.row_number().over(Window.partitionBy("io").orderBy(F.desc("block_score"), "i1")).cast("bigint").alias("rank_block"))


@q("wn5_rank_in_reference", f"WITH {SCORED} SELECT io, i1, row_number() OVER (PARTITION BY i1 ORDER BY block_score DESC, io) AS rank_block_1 FROM s")
def wn5(spark, d):
    return scored_pairs(spark, d).select("io", "i1", F.row_number().over(Window.partitionBy("i1").orderBy(F.desc("block_score"), "io")).cast("bigint").alias("rank_block_1"))


@q("wn6_group_size", f"WITH {SCORED} SELECT io, i1, count(*) OVER (PARTITION BY io) AS n_cand_o FROM s")
def wn6(spark, d):
    return scored_pairs(spark, d).select("io", "i1", F.count(F.lit(1)).over(Window.partitionBy("io")).alias("n_cand_o"))


@q("wn7_gap_to_best", f"WITH {SCORED} SELECT io, i1, round(max(block_score) OVER (PARTITION BY io) - block_score, 9) AS gap FROM s")
def wn7(spark, d):
    return scored_pairs(spark, d).select("io", "i1", F.round(F.max("block_score").over(Window.partitionBy("io")) - F.col("block_score"), 9).alias("gap"))


@q("wn8_second_best", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY block_score DESC, i1) AS n FROM s) SELECT io, i1, coalesce(max(CASE WHEN n = 2 THEN block_score END) OVER (PARTITION BY io), 0) AS second FROM r")
def wn8(spark, d):
    w = Window.partitionBy("io").orderBy(F.desc("block_score"), "i1").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return scored_pairs(spark, d).select("io", "i1", F.coalesce(F.nth_value("block_score", 2).over(w), F.lit(0.0)).alias("second"))


@q(
    "wn9_conditional",
    f"""WITH {SCORED}, {OTHERS}, j AS (SELECT s.*, o.src FROM s JOIN o USING (io)) SELECT io, i1, count(CASE WHEN p > 0.5 THEN 1 END) OVER (PARTITION BY i1) AS n_strong,
    round(coalesce(sum(CASE WHEN p > 0.5 THEN p END) OVER (PARTITION BY i1), 0), 6) AS sum_strong, coalesce(max(CASE WHEN p > 0.5 THEN p END) OVER (PARTITION BY i1, src), 0) AS max_src FROM j""",
)
def wn9(spark, d):
    j = scored_pairs(spark, d).join(others(spark, d).select("io", "src"), "io")
    strong, w = F.when(F.col("p") > 0.5, F.col("p")), Window.partitionBy("i1")
    return j.select("io", "i1", F.count(strong).over(w).alias("n_strong"), F.round(F.coalesce(F.sum(strong).over(w), F.lit(0.0)), 6).alias("sum_strong"), F.coalesce(F.max(strong).over(Window.partitionBy("i1", "src")), F.lit(0.0)).alias("max_src"))


@q("wn10_count_in_two_keys", "SELECT entity_id, count(*) OVER (PARTITION BY country, business_name) AS same_name FROM source1")
def wn10(spark, d):
    return table(spark, d, "source1").select("entity_id", F.count(F.lit(1)).over(Window.partitionBy("country", "business_name")).alias("same_name"))


@q("wn11_change_points", "SELECT event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS starts FROM events")
def wn11(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.coalesce(F.col("event_type") != F.lag("event_type").over(w), F.lit(True)).alias("starts"))


# ---- sorts, limits, samples


@q("so1_mixed_sort_top", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 100")
def so1(spark, d):
    return table(spark, d, "orders").orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus", "o_totalprice")


@q("so3_top_k_by_rank", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY tfidf_sim DESC, i1) AS n FROM s) SELECT io, i1 FROM r WHERE n <= 2")
def so3(spark, d):
    r = scored_pairs(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("io").orderBy(F.desc("tfidf_sim"), "i1")))
    return r.filter("n <= 2").select("io", "i1")


@q("so5_nth_largest", f"WITH {SCORED}, b AS (SELECT io, max(p) AS p FROM s WHERE p IS NOT NULL GROUP BY io) SELECT min(p) AS threshold FROM (SELECT p FROM b ORDER BY p DESC LIMIT 200)")
def so5(spark, d):
    """By exact positions, so that n may be in the millions; of fewer rows the last."""
    best = scored_pairs(spark, d).filter("p IS NOT NULL").groupBy("io").agg(F.max("p").alias("p")).withColumn("one", F.lit(0))
    return with_positions(best, ["one"], [F.desc("p"), "io"], "place", keep=200).agg(F.min("p").alias("threshold"))


@q("so6_seeded_sample")
def so6(spark, d):
    """A sample of 50 documents that depends on the seed and the ids only."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(50)


@q("so7_hash_split")
def so7(spark, d):
    """Ten folds by a seeded hash; a feature of the sampling operator, every row has its fold."""
    return table(spark, d, "source1").select("entity_id", F.pmod(F.xxhash64("entity_id", F.lit(5)), F.lit(10)).alias("fold"))


@q("so8_permutation", "SELECT doc_id, row_number() OVER (ORDER BY md5('13-' || doc_id::VARCHAR), doc_id) AS place FROM documents")
def so8(spark, d):
    """The place of every row in a seeded permutation, by exact positions of a range-partitioned sort."""
    keyed = table(spark, d, "documents").select("doc_id", F.lit(0).alias("one"), F.md5(F.concat(F.lit("13-"), F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    return with_positions(keyed, ["one"], ["h", "doc_id"], "place").select("doc_id", "place")


# ---- set operations


@q("st1_union_all", "SELECT entity_id, 2 AS src FROM source2 UNION ALL SELECT entity_id, 3 FROM source3")
def st1(spark, d):
    return table(spark, d, "source2").select("entity_id", F.lit(2).alias("src")).unionByName(table(spark, d, "source3").select("entity_id", F.lit(3).alias("src")))


@q("st2_union_distinct", "SELECT country FROM source1 UNION SELECT country FROM source2 UNION SELECT country FROM source3")
def st2(spark, d):
    a, b, c = (table(spark, d, t).select("country") for t in ("source1", "source2", "source3"))
    return a.union(b).union(c).distinct()


@q("st3_except_intersect", f"""WITH {SCORED}, a AS (SELECT io, i1 FROM s WHERE p >= 0.5), b AS (SELECT io, i1 FROM s WHERE block_score > 30)
    SELECT io, i1, 'removed' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT io, i1, 'kept' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def st3(spark, d):
    s = scored_pairs(spark, d)
    a, b = s.filter("p >= 0.5").select("io", "i1"), s.filter("block_score > 30").select("io", "i1")
    return a.join(b, ["io", "i1"], "left_anti").withColumn("side", F.lit("removed")).unionByName(a.join(b, ["io", "i1"], "left_semi").withColumn("side", F.lit("kept")))


@q(
    "st4_array_sets",
    """WITH w AS (SELECT entity_id, list_distinct(string_split(business_name, ' ')) AS a, list_distinct(string_split(business_address, ' ')) AS b FROM source1)
    SELECT entity_id, len(list_intersect(a, b))::BIGINT AS n_both, len(list_distinct(list_concat(a, b)))::BIGINT AS n_any, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS n_only FROM w""",
)
def st4(spark, d):
    a, b = F.split("business_name", " "), F.split("business_address", " ")
    size = lambda x: F.size(x).cast("bigint")
    return table(spark, d, "source1").select("entity_id", size(F.array_intersect(a, b)).alias("n_both"), size(F.array_union(a, b)).alias("n_any"), size(F.array_except(a, b)).alias("n_only"))


# ---- scalar functions


@q("sc2_6_strings", "SELECT p_partkey, lower(p_brand) AS low, replace(p_name, ' ', '_') AS under, length(p_name)::INTEGER AS n, starts_with(p_type, 'PROMO') AS promo, p_name[1:9] AS head, trim(p_name || ' ') AS trimmed FROM part")
def sc_strings(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower("p_brand").alias("low"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("under"), F.char_length("p_name").alias("n"), F.col("p_type").startswith("PROMO").alias("promo"), F.substring("p_name", 1, 9).alias("head"), F.trim(F.concat("p_name", F.lit(" "))).alias("trimmed"))


@q("sc3_regex_replace", r"SELECT doc_id, regexp_replace(coalesce(title, ''), '[^a-zA-Z]+', ' ', 'g') AS letters FROM documents")
def sc3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("title", F.lit("")), "[^a-zA-Z]+", " ").alias("letters"))


@q("sc4_regex_contains", r"SELECT doc_id, regexp_matches(text, '(?i)#redirect') AS redirect FROM documents")
def sc4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike("(?i)#redirect").alias("redirect"))


@q("sc5_regex_extract", r"SELECT entity_id, regexp_extract_all(business_address, '[0-9]+')[1] AS num0, len(regexp_extract_all(business_address, '[0-9]+'))::INTEGER AS n FROM source1")
def sc5(spark, d):
    nums = F.regexp_extract_all("business_address", F.lit("[0-9]+"), 0)
    return table(spark, d, "source1").select("entity_id", F.get(nums, F.lit(0)).alias("num0"), F.size(nums).alias("n"))


@q("sc12_maths", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + l_quantity), 6) AS lg, (l_orderkey // 7)::BIGINT AS seven, (l_orderkey % 4)::BIGINT AS four, greatest(l_discount, l_tax) AS hi, least(l_discount, l_tax) AS lo, abs(l_tax - l_discount) AS apart FROM lineitem")
def sc12(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.log1p("l_quantity"), 6).alias("lg"), F.floor(F.col("l_orderkey") / 7).alias("seven"), F.pmod("l_orderkey", F.lit(4)).alias("four"), F.greatest("l_discount", "l_tax").alias("hi"), F.least("l_discount", "l_tax").alias("lo"), F.abs(F.col("l_tax") - F.col("l_discount")).alias("apart"))


@q("sc13_null_equality", "SELECT doc_id, coalesce(source = lang, false) AS same FROM documents")
def sc13(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.col("source") == F.col("lang"), F.lit(False)).alias("same"))


@q("sc14_right_closed_bins", f"WITH {SCORED} SELECT CASE WHEN p <= 0.3 THEN '0.3' WHEN p <= 0.5 THEN '0.5' WHEN p <= 0.85 THEN '0.85' ELSE '1' END AS upper_edge, count(*)::BIGINT AS n FROM s WHERE p IS NOT NULL GROUP BY 1")
def sc14(spark, d):
    edge = F.when(F.col("p") <= 0.3, "0.3").when(F.col("p") <= 0.5, "0.5").when(F.col("p") <= 0.85, "0.85").otherwise("1")
    return scored_pairs(spark, d).filter("p IS NOT NULL").groupBy(edge.alias("upper_edge")).agg(F.count(F.lit(1)).alias("n"))


@q("sc15_string_to_number", r"SELECT entity_id, try_cast(regexp_extract(business_address, '([0-9]{1,9})', 1) AS DOUBLE) AS num FROM source3")
def sc15(spark, d):
    return table(spark, d, "source3").select("entity_id", F.regexp_extract("business_address", "([0-9]{1,9})", 1).try_cast("double").alias("num"))


@q("sc16_sigmoid", "SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS s FROM embeddings")
def sc16(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(1 / (1 + F.exp(-F.get("embedding", F.lit(0)).cast("double"))), 6).alias("s"))


@q("sc11_hash")
def sc11(spark, d):
    return table(spark, d, "blocking_keys").select("id", "src", F.xxhash64(F.lit(17), "country", "key").alias("hash"))
