"""Record-linkage operators of the inventory: sources, cleaning, dictionaries, blocking, similarity, features, decisions.

Where SQL follows the Unicode rules only for plain Latin text, the checked query runs over source1, the clean list, and the one beside it named
``_all_records`` over source1, source2 and source3, without SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import similarity, text, wordlists
from weftwork.operators import blocking, decide, features, translit
from weftwork.plans.registry import Registry
from weftwork.plans.relational import OTHERS, SCORED, others, scored_pairs
from weftwork.session import _ensure_checkpoint_dir, cut, table
from weftwork.sources import files

REG = Registry()
q = REG.query


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one."""
    return f"{_ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def number(col: str) -> F.Column:
    return F.regexp_extract(col, r"-(\d+)$", 1).cast("bigint")


def reference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source1").withColumn("i1", number("entity_id"))


def clean_reference(spark: SparkSession, d: str) -> DataFrame:
    return text.add_clean(reference(spark, d))


def all_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of source1, source2 and source3 as stored, each once."""
    keep = ["entity_id", "business_name", "business_address", "country"]
    return table(spark, d, "source1").select(*keep).unionByName(others(spark, d).select(*keep))


def clean_records(spark: SparkSession, d: str) -> DataFrame:
    return text.add_clean(all_records(spark, d))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return files.truth_pairs(table(spark, d, "match_labels"))


# ---- SQL shared by the oracles


def _lit(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _map(table_: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(table_.items())) + "}"


def clean_sql(col: str) -> str:
    bare = rf"regexp_replace(replace(lower(strip_accents(coalesce({col}, ''))), '&', ' & '), '\.(com|in|net|org|co|fr)\b|www\.', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '[^\p{{L}}\p{{N}}&]+', ' ', 'g'), ' +', ' ', 'g'))"


def states_sql(expr: str) -> str:
    for name in sorted((s for s in text.STATES if " " in s), key=lambda s: (-len(s), s)):
        expr = rf"regexp_replace({expr}, '\b{name}\b', '{text.STATES[name]}', 'g')"
    return expr


def words_sql(expr: str) -> str:
    return f"list_filter(string_split({expr}, ' '), lambda w: w <> '')"


def mapped_sql(expr: str, table_: dict[str, str]) -> str:
    return f"list_transform({expr}, lambda w: coalesce({_map(table_)}[w], w))"


DELEET = "CASE WHEN regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, '^[0-9]+[a-z]{1,2}$') THEN translate(w, '013547', 'olesat') ELSE w END"
CLEAN1 = f"c1 AS (SELECT entity_id, CAST(regexp_extract(entity_id, '-([0-9]+)$', 1) AS BIGINT) AS i1, country, business_name, {clean_sql('business_name')} AS nm, {states_sql(clean_sql('business_address'))} AS ad FROM source1)"
NAME_TOKENS = mapped_sql(f"list_transform({words_sql('nm')}, lambda w: {DELEET})", wordlists.NAME_WORDS)
ADDRESS_TOKENS = mapped_sql(mapped_sql(words_sql("ad"), wordlists.ADDRESS_WORDS), text.STATES)
CORE = f"list_filter(tok, lambda w: NOT list_contains({_lit(wordlists.LEGAL_WORDS + wordlists.FILLER_WORDS)}, w))"
PREPARED1 = f"""t1 AS (SELECT *, {NAME_TOKENS} AS tok FROM c1), p1 AS (SELECT entity_id, i1, country, nm, ad, array_to_string({CORE}, ' ') AS core,
array_to_string(list_sort(list_distinct(list_filter(tok, lambda w: list_contains({_lit([w for w in wordlists.LEGAL_WORDS if w not in wordlists.WEAK_LEGAL])}, w)))), ' ') AS legal,
array_to_string({mapped_sql(words_sql('ad'), text.ADDRESS_MAP)}, ' ') AS adc, regexp_extract_all(ad, '[0-9]+')[1] AS num0 FROM t1)"""
TRUTH = "g AS (SELECT source1_entity_id AS s1_id, unnest(string_split(matched_entity_ids, ',')) AS o_id FROM match_labels WHERE matched_entity_ids <> '')"
TRUTH_N = TRUTH + ", gn AS (SELECT CAST(regexp_extract(s1_id, '-([0-9]+)$', 1) AS BIGINT) AS i1, CAST(regexp_extract(o_id, '-([0-9]+)$', 1) AS BIGINT) AS io FROM g)"


# ---- sources and sinks


@q("src1_delimited_scan", "SELECT entity_id, coalesce(business_name, '') AS business_name, coalesce(business_address, '') AS business_address, coalesce(country, '') AS country FROM source3")
def src1(spark, d):
    path = _scratch(spark, "tsv")
    files.write_tsv(table(spark, d, "source3").select(*files.RECORD.names), path)
    return files.read_tsv(spark, path)


@q("src2_load_split", "SELECT entity_id, business_name, country, 2 AS src FROM source2 UNION ALL SELECT entity_id, business_name, country, 3 FROM source3")
def src2(spark, d):
    return files.load_split(spark, d)[1].select("entity_id", "business_name", "country", F.col("src").cast("int").alias("src"))


@q("src3_truth_pairs", f"WITH {TRUTH} SELECT s1_id, o_id FROM g")
def src3(spark, d):
    return truth(spark, d)


@q("src4_projection", "SELECT doc_id, lang FROM documents")
def src4(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang")


@q("src5_pushed_filter", "SELECT io, i1, block_score FROM candidate_pairs WHERE n_shared >= 4")
def src5(spark, d):
    return table(spark, d, "candidate_pairs").filter("n_shared >= 4").select("io", "i1", "block_score")


@q("src6_many_files", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def src6(spark, d):
    path = _scratch(spark, "parts")
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus").repartition(6, "o_orderkey").write.parquet(path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@q("src7_id_lists", f"WITH {TRUTH} SELECT s1_id, count(DISTINCT o_id)::BIGINT AS n FROM g GROUP BY 1")
def src7(spark, d):
    return truth(spark, d).groupBy("s1_id").agg(F.countDistinct("o_id").alias("n"))


@q(
    "snk1_id_lists",
    f"WITH {TRUTH}, l AS (SELECT s1_id, string_agg(DISTINCT o_id, ',' ORDER BY o_id) AS x FROM g GROUP BY 1) SELECT entity_id AS source1_entity_id, coalesce(x, '') AS matched_entity_ids FROM source1 LEFT JOIN l ON entity_id = s1_id",
)
def snk1(spark, d):
    path = _scratch(spark, "lists")
    lists = files.id_lists(table(spark, d, "source1").select(F.col("entity_id").alias("s1_id")), truth(spark, d))
    files.write_tsv(lists, path, single=True)
    return files.read_tsv(spark, path, lists.schema)


@q(
    "snk2_candidate_lists",
    f"""WITH {SCORED}, {OTHERS}, l AS (SELECT i1, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS x FROM s JOIN o USING (io) WHERE p >= 0.01 GROUP BY 1)
    SELECT entity_id AS source1_entity_id, coalesce(x, '') AS candidate_entity_ids FROM source1 LEFT JOIN l ON CAST(regexp_extract(entity_id, '-([0-9]+)$', 1) AS BIGINT) = i1""",
)
def snk2(spark, d):
    ids = reference(spark, d).select("i1", F.col("entity_id").alias("s1_id"))
    pairs = scored_pairs(spark, d).filter("p >= 0.01").join(others(spark, d).select("io", F.col("entity_id").alias("o_id")), "io").join(ids, "i1")
    return files.id_lists(ids, pairs, "candidate_entity_ids")


@q("snk3_parquet_round_trip", "SELECT * FROM region")
def snk3(spark, d):
    path = _scratch(spark, "region")
    table(spark, d, "region").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@q("snk4_materialised_once", "SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def snk4(spark, d):
    path = _scratch(spark, "kept")
    make = lambda: table(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    files.materialised(path, spark, make)
    return files.materialised(path, spark, lambda: 1 / 0)  # there already: not made again


@q("snk5_replaced", "SELECT r_regionkey FROM region")
def snk5(spark, d):
    path = _scratch(spark, "replaced")
    table(spark, d, "nation").select("n_nationkey").write.mode("overwrite").parquet(path)
    table(spark, d, "region").select("r_regionkey").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---- cleaning


@q("tx1_clean", f"WITH {CLEAN1} SELECT entity_id, nm FROM c1")
def tx1(spark, d):
    return clean_reference(spark, d).select("entity_id", "nm")


@q("tx1_clean_all_scripts")
def tx1b(spark, d):
    """Names in any script; SQL has no compatibility decomposition, so this one is tested against a plain version."""
    return others(spark, d).select("entity_id", text.clean("business_name").alias("nm"))


@q("tx2_states_to_codes", f"WITH {CLEAN1} SELECT entity_id, ad FROM c1")
def tx2(spark, d):
    return clean_reference(spark, d).select("entity_id", "ad")


@q("tx3_prefers_latin_columns", f"SELECT entity_id, {clean_sql('business_address')} AS nm FROM source1")
def tx3(spark, d):
    rows = table(spark, d, "source1").withColumn("name_lat", F.col("business_address"))
    return text.add_clean(rows).select("entity_id", "nm")


@q("tx4_name_tokens", f"WITH {CLEAN1} SELECT entity_id, array_to_string({NAME_TOKENS}, ' ') AS tokens FROM c1")
def tx4(spark, d):
    return clean_reference(spark, d).select("entity_id", F.array_join(text.name_tokens(F.col("nm")), " ").alias("tokens"))


@q("tx4_name_tokens_all_records")
def tx4b(spark, d):
    return clean_records(spark, d).select("entity_id", F.array_join(text.name_tokens(F.col("nm")), " ").alias("tokens"))


@q("tx5_address_tokens", f"WITH {CLEAN1} SELECT entity_id, array_to_string({ADDRESS_TOKENS}, ' ') AS tokens FROM c1")
def tx5(spark, d):
    return clean_reference(spark, d).select("entity_id", F.array_join(text.address_tokens(F.col("ad")), " ").alias("tokens"))


@q("tx5_address_tokens_all_records")
def tx5b(spark, d):
    return clean_records(spark, d).select("entity_id", F.array_join(text.address_tokens(F.col("ad")), " ").alias("tokens"))


@q("tx6_prepare", f"WITH {CLEAN1}, {PREPARED1} SELECT entity_id, core, legal, adc, num0 FROM p1")
def tx6(spark, d):
    return text.prepare(clean_reference(spark, d)).select("entity_id", "core", "legal", "adc", "num0")


@q("tx6_prepare_all_records")
def tx6d(spark, d):
    return text.prepare(clean_records(spark, d)).select("entity_id", "core", "legal", "adc", "num0")


@q("tx6_flags", r"SELECT DISTINCT entity_id, regexp_matches(coalesce(business_name, ''), '[\x{0900}-\x{0DFF}]') AS indic, regexp_matches(coalesce(business_name, ''), '(?i)\.com|\.in\b|^[#@]') AS webname, regexp_matches(coalesce(business_name, ''), '(?i)\b(dba|fka|aka|a/k/a|d/b/a|f/k/a)\b') AS alias FROM source3 WHERE regexp_matches(business_name, '^[ -~]*$')")
def tx6b(spark, d):
    """Flags of the names in plain ASCII: where a letter of another script touches, word borders differ between the engines."""
    rows = table(spark, d, "source3").filter(F.col("business_name").rlike("^[ -~]*$"))
    rows = rows.withColumns({"nm": text.clean("business_name"), "ad": text.clean("business_address")})
    return text.prepare(rows).select("entity_id", "indic", "webname", "alias").distinct()


@q("tx6_flags_all_scripts")
def tx6c(spark, d):
    """Flags of the names of all sources in any script; a word ends where no letter, mark or digit of any script follows."""
    return text.prepare(text.add_clean(all_records(spark, d))).select("entity_id", "indic", "webname", "alias")


@q("tx8_script_words", r"SELECT entity_id, array_to_string(string_split(trim(regexp_replace(lower(business_name), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')), ' '), '|') AS words FROM source1")
def tx8(spark, d):
    return table(spark, d, "source1").select("entity_id", F.array_join(text.script_words(F.col("business_name")), "|").alias("words"))


@q("tx8_script_words_all_records")
def tx8b(spark, d):
    return all_records(spark, d).select("entity_id", F.array_join(text.script_words(F.coalesce("business_name", F.lit(""))), "|").alias("words"))


@q("tx9_indic", r"SELECT count(*)::BIGINT AS n FROM source3 WHERE regexp_matches(business_name, '[\x{0900}-\x{0DFF}]')")
def tx9(spark, d):
    return table(spark, d, "source3").filter(F.col("business_name").rlike(text.INDIC)).agg(F.count(F.lit(1)).alias("n"))


@q("tx10_model_text", "SELECT entity_id, regexp_replace(trim(business_name), ' +', ' ', 'g') || ' | ' || regexp_replace(trim(business_address), ' +', ' ', 'g') AS t FROM source1")
def tx10(spark, d):
    rows = clean_reference(spark, d)
    return rows.select("entity_id", text.model_text(F.col("business_name"), F.col("business_address"), F.col("nm"), F.col("business_name").rlike(text.INDIC)).alias("t"))


@q("tx10_model_text_all_records")
def tx10b(spark, d):
    rows = clean_records(spark, d)
    indic = F.coalesce("business_name", F.lit("")).rlike(text.INDIC)
    return rows.select("entity_id", text.model_text(F.col("business_name"), F.col("business_address"), F.col("nm"), indic).alias("t"))


@q("tx11_street_key", f"WITH {CLEAN1}, {PREPARED1} SELECT entity_id, regexp_replace(adc, '[0-9]+', '', 'g') AS street FROM p1")
def tx11(spark, d):
    return text.prepare(clean_reference(spark, d)).select("entity_id", F.regexp_replace("adc", "[0-9]+", "").alias("street"))


@q("tx11_street_key_all_records")
def tx11b(spark, d):
    return text.prepare(clean_records(spark, d)).select("entity_id", F.regexp_replace("adc", r"(?U)\d+", "").alias("street"))


@q("sc8_9_undo_digits", f"SELECT DISTINCT entity_id, array_to_string(list_transform(string_split(lower(coalesce(business_name, '')), ' '), lambda w: {DELEET}), ' ') AS nm FROM source3")
def sc9(spark, d):
    words = F.transform(F.split(F.lower(F.coalesce("business_name", F.lit(""))), " "), text.undo_digits)
    return table(spark, d, "source3").select("entity_id", F.array_join(words, " ").alias("nm")).distinct()


# ---- dictionaries

LEARN = rf"""m AS (SELECT string_split(trim(regexp_replace(lower(a.business_name), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g')), ' ') AS w1, string_split(trim(regexp_replace(lower(o.business_name), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g')), ' ') AS w2
FROM g JOIN source1 a ON a.entity_id = g.s1_id JOIN o ON o.entity_id = g.o_id WHERE regexp_matches(o.business_name, '[\x{{0900}}-\x{{0DFF}}]')),
e AS (SELECT unnest(w2) AS src_tok, unnest(w1) AS dst_tok FROM m WHERE len(w1) = len(w2)),
k AS (SELECT src_tok, dst_tok, count(*) AS n FROM e WHERE regexp_matches(src_tok, '[\x{{0900}}-\x{{0DFF}}]') AND NOT regexp_matches(dst_tok, '[\x{{0900}}-\x{{0DFF}}]') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY src_tok ORDER BY n DESC, dst_tok) AS rk, sum(n) OVER (PARTITION BY src_tok) AS t FROM k),
dict AS (SELECT src_tok, dst_tok FROM r WHERE rk = 1 AND n >= 2 AND n >= 0.5 * t)"""


def _learned(spark, d) -> DataFrame:
    return translit.learn_words(table(spark, d, "source1"), others(spark, d), truth(spark, d))


@q("tl1_learn_words", f"WITH {TRUTH}, {OTHERS}, {LEARN} SELECT src_tok, dst_tok FROM dict")
def tl1(spark, d):
    return _learned(spark, d)


@q(
    "tl2_learn_address_parts",
    rf"""WITH {TRUTH}, {OTHERS}, e AS (SELECT lower(trim(string_split(a.business_address, ',')[-1])) AS dst_tok, unnest(list_transform(string_split(o.business_address, ','), lambda x: lower(trim(x)))) AS src_tok
    FROM g JOIN source1 a ON a.entity_id = g.s1_id JOIN o ON o.entity_id = g.o_id), k AS (SELECT src_tok, dst_tok, count(*) AS n FROM e WHERE regexp_matches(src_tok, '[\x{{0900}}-\x{{0DFF}}]') GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY src_tok ORDER BY n DESC, dst_tok) AS rk, sum(n) OVER (PARTITION BY src_tok) AS t FROM k) SELECT src_tok, dst_tok FROM r WHERE rk = 1 AND n >= 1 AND n >= 0.6 * t""",
)
def tl2(spark, d):
    """With support of one: the labelled part of the smallest tables holds few such addresses."""
    return translit.learn_address_parts(table(spark, d, "source1"), others(spark, d), truth(spark, d), min_count=1)


@q("tl3_transliterate_names", f"""WITH {TRUTH}, {OTHERS}, {LEARN}, x AS (SELECT entity_id, string_split(trim(regexp_replace(lower(coalesce(business_name, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')), ' ') AS l FROM o),
    w AS (SELECT entity_id, unnest(l) AS w, unnest(range(len(l))) AS i FROM x) SELECT entity_id, string_agg(coalesce(dst_tok, w), ' ' ORDER BY i) AS name_lat FROM w LEFT JOIN dict ON src_tok = w GROUP BY 1""")
def tl3(spark, d):
    return translit.transliterate_names(others(spark, d), cut(_learned(spark, d))).select("entity_id", "name_lat")


def translated(spark, d) -> DataFrame:
    """Records of both other sources with their names in Latin by a dictionary learned from labelled pairs only: what blocking and features
    then read in place of the stored names."""
    names = translit.transliterate_names(others(spark, d), cut(_learned(spark, d))).select("entity_id", "name_lat")
    rows = others(spark, d).join(names, "entity_id").withColumn("business_name", F.coalesce(F.nullif("name_lat", F.lit("")), "business_name")).drop("name_lat")
    return text.add_clean(rows)


@q("tl5_candidates_by_translated_names")
def tl5(spark, d):
    """From labelled pairs to dictionary to keys to candidates."""
    return blocking.generate_candidates(clean_reference(spark, d).select("i1", "country", "nm", "ad"), cut(translated(spark, d).select("io", "country", "nm", "ad")))


@q(
    "tl4_transliterate_addresses",
    rf"""WITH {TRUTH}, {OTHERS}, e AS (SELECT lower(trim(string_split(a.business_address, ',')[-1])) AS dst_tok, unnest(list_transform(string_split(o.business_address, ','), lambda x: lower(trim(x)))) AS src_tok
    FROM g JOIN source1 a ON a.entity_id = g.s1_id JOIN o ON o.entity_id = g.o_id), k AS (SELECT src_tok, dst_tok, count(*) AS n FROM e WHERE regexp_matches(src_tok, '[\x{{0900}}-\x{{0DFF}}]') GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY src_tok ORDER BY n DESC, dst_tok) AS rk, sum(n) OVER (PARTITION BY src_tok) AS t FROM k), dict AS (SELECT src_tok, dst_tok FROM r WHERE rk = 1 AND n >= 0.6 * t),
    w AS (SELECT entity_id, unnest(string_split(coalesce(business_address, ''), ',')) AS w, unnest(range(len(string_split(coalesce(business_address, ''), ',')))) AS i FROM o)
    SELECT entity_id, string_agg(coalesce(dst_tok, trim(w)), ', ' ORDER BY i) AS addr_lat FROM w LEFT JOIN dict ON src_tok = lower(trim(w)) GROUP BY 1""",
)
def tl4(spark, d):
    learned = cut(translit.learn_address_parts(table(spark, d, "source1"), others(spark, d), truth(spark, d), min_count=1))
    return translit.transliterate_addresses(others(spark, d), learned).select("entity_id", "addr_lat")


# ---- blocking


@q(
    "bk1_record_keys",
    f"""WITH {CLEAN1}, t AS (SELECT entity_id, country, {NAME_TOKENS} AS tok, {ADDRESS_TOKENS}[1:20] AS adr FROM c1), h AS (SELECT *, CASE WHEN len({CORE}) > 0 THEN {CORE} ELSE tok END AS core FROM t),
    f AS (SELECT entity_id, country, core, core[1:4] AS head, adr, list_filter(adr, lambda w: length(w) >= 3 OR regexp_matches(w, '^[0-9]+$')) AS picked0 FROM h),
    d AS (SELECT *, list_filter(picked0, lambda x, i: list_position(picked0, x) = i)[1:10] AS picked FROM f),
    k AS (SELECT entity_id, country, 'n|' || unnest(head) AS key FROM d UNION SELECT entity_id, country, 'a|' || unnest(picked) FROM d
    UNION SELECT x.entity_id, x.country, 'nn|' || x.a || '_' || y.b FROM (SELECT entity_id, country, unnest(head) AS a FROM d) x JOIN (SELECT entity_id, unnest(head) AS b FROM d) y USING (entity_id) WHERE x.a < y.b
    UNION SELECT entity_id, country, 'aa|' || unnest(list_transform(range(1, len(adr)), lambda i: adr[i] || '_' || adr[i + 1])) FROM d WHERE len(adr) > 1
    UNION SELECT x.entity_id, x.country, 'na|' || x.a || '@' || y.b FROM (SELECT entity_id, country, unnest(head) AS a FROM d) x JOIN (SELECT entity_id, unnest(picked) AS b FROM d) y USING (entity_id)
    UNION SELECT entity_id, country, 'c|' || array_to_string(core, '') FROM d WHERE length(array_to_string(core, '')) >= 5) SELECT entity_id, country, key FROM k""",
)
def bk1(spark, d):
    return blocking.record_keys(clean_reference(spark, d), "entity_id")


@q("bk1_record_keys_all_records")
def bk1b(spark, d):
    return blocking.record_keys(clean_records(spark, d), "entity_id")


BK = """k AS (SELECT DISTINCT src, id, country, key FROM blocking_keys WHERE key IS NOT NULL), sz AS (SELECT country, count(*) AS n FROM source1 GROUP BY 1),
ix AS (SELECT country, key, df, ln(n / df) AS idf FROM (SELECT country, key, count(*) AS df FROM k WHERE src = 1 GROUP BY 1, 2) JOIN sz USING (country) WHERE df <= 1000)"""
BK3 = "qk AS (SELECT k.src, id AS io, country, key, df, idf FROM k JOIN ix USING (country, key) WHERE src > 1), qb AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY df, key) - 1 AS rk, sum(df) OVER (PARTITION BY io ORDER BY df, key ROWS UNBOUNDED PRECEDING) - df AS bf FROM qk), qq AS (SELECT * FROM qb WHERE rk = 0 OR (rk < 24 AND bf < 10000))"


def _block_inputs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = table(spark, d, "blocking_keys").filter("key IS NOT NULL").select("src", "id", "country", "key").distinct()
    sizes = table(spark, d, "source1").groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return k.filter("src = 1").select(F.col("id").alias("i1"), "country", "key"), k.filter("src > 1").select(F.col("id").alias("io"), "country", "key"), sizes


@q("bk2_key_index", f"WITH {BK} SELECT country, key, df::BIGINT AS df, round(idf, 9) AS idf FROM ix")
def bk2(spark, d):
    s1, _, sizes = _block_inputs(spark, d)
    return blocking.key_index(s1, sizes, 1000).withColumn("idf", F.round("idf", 9))


@q("bk3_key_budget", f"WITH {BK}, {BK3} SELECT io, country, key, df::BIGINT AS df FROM qq")
def bk3(spark, d):
    s1, o, sizes = _block_inputs(spark, d)
    rows = o.join(blocking.key_index(s1, sizes, 1000), ["country", "key"])
    return blocking.within_budget(rows, "io", 24, 10_000).select("io", "country", "key", "df")


BK4 = f"WITH {BK}, {BK3}, m AS (SELECT io, k.id AS i1, round(sum(idf), 9) AS block_score, count(*)::BIGINT AS n_shared FROM qq JOIN k ON k.src = 1 AND k.country = qq.country AND k.key = qq.key GROUP BY 1, 2), tk AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY block_score DESC, i1) AS n FROM m)"


@q("bk4_key_candidates")
def bk4(spark, d):
    """The production setting; idf sums that differ in the last bit order ties anew, so ties are settled on rounded scores in the checked form below."""
    return blocking.key_candidates(*_block_inputs(spark, d))


@q("bk5_rounded_candidates", BK4 + " SELECT io, i1, block_score, n_shared FROM tk WHERE n <= 10")
def bk5(spark, d):
    s1, o, sizes = _block_inputs(spark, d)
    index = blocking.key_index(s1, sizes, 1000)
    met = blocking.within_budget(o.join(index, ["country", "key"]), "io", 24, 10_000).join(s1, ["country", "key"])
    scored = met.groupBy("io", "i1").agg(F.round(F.sum("idf"), 9).alias("block_score"), F.count(F.lit(1)).alias("n_shared"))
    return blocking.top_candidates(scored, 10)


@q("bk5_generate_candidates")
def bk5b(spark, d):
    """Records to keys to candidates: all six families of both sides' own keys, in the production setting."""
    return blocking.generate_candidates(clean_reference(spark, d), text.add_clean(others(spark, d)))


def _core_texts(spark, d) -> tuple[DataFrame, DataFrame]:
    make = lambda rows: text.prepare(text.add_clean(rows)).withColumn("text", F.when(F.col("core") != "", F.col("core")).otherwise(F.col("nm")))
    return make(reference(spark, d)).select("i1", "country", "text"), make(others(spark, d)).select("io", "country", "text")


@q("bk6_tfidf_candidates")
def bk6(spark, d):
    s1, o = _core_texts(spark, d)
    return blocking.tfidf_candidates(s1, o).withColumn("tfidf_sim", F.round("tfidf_sim", 6))


@q("bk7_merged_passes", """WITH a AS (SELECT io, i1, max(block_score) AS block_score, max(n_shared) AS n_shared FROM candidate_pairs WHERE n_shared > 0 GROUP BY 1, 2), b AS (SELECT io, i1, max(tfidf_sim) AS tfidf_sim FROM candidate_pairs WHERE tfidf_sim > 0 GROUP BY 1, 2)
    SELECT io, i1, coalesce(block_score, 0) AS block_score, coalesce(n_shared, 0) AS n_shared, coalesce(tfidf_sim, 0) AS tfidf_sim FROM a FULL JOIN b USING (io, i1)""")
def bk7(spark, d):
    c = table(spark, d, "candidate_pairs")
    a = c.filter("n_shared > 0").groupBy("io", "i1").agg(F.max("block_score").alias("block_score"), F.max("n_shared").alias("n_shared"))
    return blocking.merge_passes(a, c.filter("tfidf_sim > 0").groupBy("io", "i1").agg(F.max("tfidf_sim").alias("tfidf_sim")))


@q("bk8_keys_only_top_ten", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY block_score DESC, i1) AS n FROM s WHERE n_shared > 0) SELECT io, i1, block_score FROM r WHERE n <= 10")
def bk8(spark, d):
    return blocking.top_candidates(scored_pairs(spark, d).filter("n_shared > 0"), 10).select("io", "i1", "block_score")


@q("bk9_reference_context", f"WITH {SCORED} SELECT io, i1, count(*) OVER (PARTITION BY i1) AS n_cand_1, row_number() OVER (PARTITION BY i1 ORDER BY block_score DESC, io) AS rank_block_1 FROM s")
def bk9(spark, d):
    return blocking.reference_context(scored_pairs(spark, d)).select("io", "i1", "n_cand_1", F.col("rank_block_1").cast("bigint").alias("rank_block_1"))


@q("bk10_anchors", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY block_score DESC, i1) AS n FROM s) SELECT io, i1 AS parent FROM r WHERE n = 1")
def bk10(spark, d):
    return blocking.anchors(scored_pairs(spark, d))


# ---- similarity and features


def compared(spark, d) -> DataFrame:
    """Scored pairs with the names of both sides, as stored."""
    s1, o = reference(spark, d), others(spark, d)
    return scored_pairs(spark, d).select("io", "i1").join(o.select("io", F.coalesce("business_name", F.lit("")).alias("a")), "io").join(s1.select("i1", F.col("business_name").alias("b")), "i1")


COMPARED = f"{SCORED}, {OTHERS}, x AS (SELECT s.io, s.i1, coalesce(o.business_name, '') AS a, r.business_name AS b FROM s JOIN o USING (io) JOIN source1 r ON CAST(regexp_extract(r.entity_id, '-([0-9]+)$', 1) AS BIGINT) = s.i1)"


@q("sm1_to_4_ratios")
def sm1(spark, d):
    a, b = F.col("a"), F.col("b")
    r = lambda x: F.round(x, 6)
    return compared(spark, d).select("io", "i1", r(similarity.ratio_of(a, b)).alias("ratio"), r(similarity.token_set_of(a, b)).alias("token_set"), r(similarity.token_sort_of(a, b)).alias("token_sort"), r(similarity.partial_of(a, b)).alias("partial"))


@q("sm5_jaro_winkler", f"WITH {COMPARED} SELECT io, i1, round(jaro_winkler_similarity(a, b), 6) AS jw FROM x WHERE regexp_matches(a, '^[ -~]*$') AND regexp_matches(b, '^[ -~]*$')")
def sm5(spark, d):
    """ASCII names: the SQL function counts bytes."""
    rows = compared(spark, d).filter(F.col("a").rlike("^[ -~]*$") & F.col("b").rlike("^[ -~]*$"))
    return rows.select("io", "i1", F.round(similarity.jaro_winkler_of(F.col("a"), F.col("b")), 6).alias("jw"))


@q("sm5_jaro_winkler_all_scripts")
def sm5b(spark, d):
    return compared(spark, d).select("io", "i1", F.round(similarity.jaro_winkler_of(F.col("a"), F.col("b")), 6).alias("jw"))


@q("sm6_levenshtein", f"WITH {COMPARED} SELECT io, i1, levenshtein(a, b)::INTEGER AS edits FROM x WHERE regexp_matches(a, '^[ -~]*$') AND regexp_matches(b, '^[ -~]*$')")
def sm6(spark, d):
    rows = compared(spark, d).filter(F.col("a").rlike("^[ -~]*$") & F.col("b").rlike("^[ -~]*$"))
    return rows.select("io", "i1", F.levenshtein("a", "b").alias("edits"))


@q("sm6_levenshtein_all_scripts")
def sm6b(spark, d):
    """Edits of code points."""
    return compared(spark, d).select("io", "i1", F.levenshtein("a", "b").alias("edits"))


@q("sm7_sparse_cosine")
def sm7(spark, d):
    """Every pair of a country from a cosine of 0.5 on, over all trigrams, however common, and with all partners."""
    s1, o = _core_texts(spark, d)
    return blocking.tfidf_candidates(s1, o, top_n=None, max_df=None, min_sim=0.5).select("io", "i1", F.round("tfidf_sim", 6).alias("tfidf_sim"))


def _prepared(spark, d) -> tuple[DataFrame, DataFrame]:
    return text.prepare(clean_reference(spark, d)), text.prepare(text.add_clean(others(spark, d)))


@q("ft_pair_features")
def ft_pairs(spark, d):
    """The 50 features of every scored pair."""
    s1, o = _prepared(spark, d)
    return features.pair_features(blocking.reference_context(scored_pairs(spark, d)), s1, o)


@q("ft_number_and_word_features")
def ft_words(spark, d):
    s1, o = _prepared(spark, d)
    right = s1.select("i1", *[F.col(x).alias(f"{x}_1") for x in features.RECORD_COLUMNS])
    rows = scored_pairs(spark, d).select("io", "i1").join(o.select("io", *features.RECORD_COLUMNS), "io").join(right, "i1")
    return features.word_features(features.number_features(rows)).drop(*features.RECORD_COLUMNS, *[f"{x}_1" for x in features.RECORD_COLUMNS])


PRUNED = f"""{SCORED}, {OTHERS}, pr AS (SELECT io, i1, p AS p1 FROM (SELECT *, row_number() OVER (PARTITION BY io ORDER BY p DESC NULLS LAST, i1) AS n FROM s) WHERE n <= 3 AND p >= 0.01), ps AS (SELECT pr.*, o.src FROM pr JOIN o USING (io))"""


def pruned(spark, d, least: float = 0.01, top: int = 3) -> DataFrame:
    rows = blocking.top_candidates(scored_pairs(spark, d).filter("p IS NOT NULL"), top, "p").filter(F.col("p") >= least)
    return rows.select("io", "i1", F.col("p").alias("p1")).join(others(spark, d).select("io", "src"), "io")


@q(
    "ft_competition",
    f"""WITH {PRUNED}, a AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY p1 DESC, i1) AS q_rank, max(p1) OVER (PARTITION BY io) - p1 AS q_gap, count(*) OVER (PARTITION BY io) AS q_n FROM ps),
    b AS (SELECT *, coalesce(max(CASE WHEN q_rank = 2 THEN p1 END) OVER (PARTITION BY io), 0) AS q_2nd, q_rank = 1 AS q_best, CASE WHEN q_rank = 1 THEN p1 END AS bp FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY i1 ORDER BY p1 DESC, io) AS s_rank, count(*) OVER (PARTITION BY i1) AS s_n, count(bp) OVER (PARTITION BY i1) AS s_n_best, count(CASE WHEN bp > 0.5 THEN 1 END) OVER (PARTITION BY i1) AS s_n_strong,
    round(coalesce(sum(bp) OVER (PARTITION BY i1), 0), 6) AS s_sum, coalesce(max(bp) OVER (PARTITION BY i1), 0) AS s_max, count(bp) OVER (PARTITION BY i1, src) AS s_n_best_src, count(CASE WHEN bp > 0.5 THEN 1 END) OVER (PARTITION BY i1, src) AS s_n_strong_src, coalesce(max(bp) OVER (PARTITION BY i1, src), 0) AS s_max_src FROM b)
    SELECT io, i1, p1, q_rank, round(q_gap, 6) AS q_gap, q_2nd, q_n, q_best, s_rank, s_n, s_n_best, s_n_strong, s_sum, s_max, s_n_best_src, s_n_strong_src, s_max_src, round(s_max - p1, 6) AS s_gap, round(s_max_src - p1, 6) AS s_gap_src FROM c""",
)
def ft_competition(spark, d):
    rows = features.competition(pruned(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("q_gap", "s_sum", "s_gap", "s_gap_src")} | {c: F.col(c).cast("bigint") for c in ("q_rank", "s_rank")})


@q("ft_text_model", f"""WITH {PRUNED}, j AS (SELECT ps.*, CASE WHEN s.n_shared > 0 THEN s.tfidf_sim * 10 - 3 END AS ce FROM ps JOIN s USING (io, i1)), a AS (SELECT *, coalesce(ce, -20) AS c FROM j),
    b AS (SELECT *, row_number() OVER (PARTITION BY io ORDER BY c DESC, i1) AS ce_rank, round(max(c) OVER (PARTITION BY io) - c, 6) AS ce_gap, row_number() OVER (PARTITION BY i1 ORDER BY c DESC, io) AS ce_s_rank, round(max(c) OVER (PARTITION BY i1) - c, 6) AS ce_s_gap,
    round(coalesce(nth_value(c, 2) OVER (PARTITION BY io ORDER BY c DESC, i1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), -20), 6) AS ce_2nd, round(coalesce(nth_value(c, 2) OVER (PARTITION BY i1 ORDER BY c DESC, io ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), -20), 6) AS ce_s_2nd FROM a)
    SELECT io, i1, ce, ce_rank, ce_gap, ce_s_rank, ce_s_gap, ce_2nd, ce_s_2nd, ce_rank = 1 AS ce_best, count(CASE WHEN ce_rank = 1 AND c > 0 THEN 1 END) OVER (PARTITION BY i1, src) AS ce_s_npos_src, count(CASE WHEN ce_rank = 1 AND c > 0 THEN 1 END) OVER (PARTITION BY i1) AS ce_s_npos, round(coalesce(max(CASE WHEN ce_rank = 1 THEN c END) OVER (PARTITION BY i1, src), -20) - c, 6) AS ce_s_gap_src FROM b""")
def ft_text_model(spark, d):
    """The cosine stands in for a text model's score; pairs that no key found have none."""
    ce = scored_pairs(spark, d).select("io", "i1", F.when(F.col("n_shared") > 0, F.col("tfidf_sim") * 10 - 3).alias("ce"))
    rows = features.text_model_features(pruned(spark, d).join(ce, ["io", "i1"]))
    cols = [F.round(c, 6).alias(c) if "gap" in c or "2nd" in c else F.col(c).cast("bigint").alias(c) if c.endswith("rank") else F.col(c) for c in ("ce_rank", "ce_gap", "ce_s_rank", "ce_s_gap", "ce_2nd", "ce_s_2nd", "ce_best", "ce_s_npos", "ce_s_npos_src", "ce_s_gap_src")]
    return rows.select("io", "i1", "ce", *cols)


# ---- decisions and measures


def predicted(spark, d, tau: float = 0.5) -> DataFrame:
    ids = reference(spark, d).select("i1", F.col("entity_id").alias("s1_id"))
    return decide.assign(scored_pairs(spark, d), tau).join(ids, "i1").join(others(spark, d).select("io", F.col("entity_id").alias("o_id")), "io").select("s1_id", "o_id")


BEST = f"{SCORED}, {OTHERS}, b AS (SELECT io, i1, p FROM (SELECT *, row_number() OVER (PARTITION BY io ORDER BY p DESC NULLS LAST, i1) AS n FROM s) WHERE n = 1)"
PREDICTED = f"{BEST}, pd AS (SELECT r.entity_id AS s1_id, o.entity_id AS o_id, b.p FROM b JOIN o USING (io) JOIN source1 r ON CAST(regexp_extract(r.entity_id, '-([0-9]+)$', 1) AS BIGINT) = b.i1)"
F_HALF = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"


def per_entity_sql(tau: float = 0.5) -> str:
    return f"""{TRUTH}, {PREDICTED}, h AS (SELECT s1_id, o_id FROM pd WHERE p >= {tau}), c AS (SELECT coalesce(h.s1_id, g.s1_id) AS s1_id, count(CASE WHEN h.o_id IS NOT NULL AND g.o_id IS NOT NULL THEN 1 END)::DOUBLE AS tp, count(h.o_id)::DOUBLE AS n_pred, count(g.o_id)::DOUBLE AS n_true
    FROM h FULL JOIN g ON h.s1_id = g.s1_id AND h.o_id = g.o_id GROUP BY 1), e AS (SELECT l.source1_entity_id AS s1_id, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true FROM match_labels l LEFT JOIN c ON c.s1_id = l.source1_entity_id), f AS (SELECT *, {F_HALF} AS f FROM e)"""


def labelled(spark, d) -> DataFrame:
    return table(spark, d, "match_labels").select(F.col("source1_entity_id").alias("s1_id"))


@q("de1_assign", f"WITH {BEST} SELECT io, i1 FROM b WHERE p >= 0.5")
def de1(spark, d):
    return decide.assign(scored_pairs(spark, d), 0.5)


TAUS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95]


@q("de2_threshold_sweep", " UNION ALL ".join(f"SELECT * FROM (WITH {per_entity_sql(t)} SELECT {t}::DOUBLE AS tau, round(avg(f), 9) AS macro_f05, sum(n_pred)::BIGINT AS n_pred FROM f)" for t in TAUS))
def de2(spark, d):
    ids = reference(spark, d).select("i1", F.col("entity_id").alias("s1_id"))
    best = decide.best_candidates(scored_pairs(spark, d)).join(ids, "i1").join(others(spark, d).select("io", F.col("entity_id").alias("o_id")), "io").select("s1_id", "o_id", "p")
    return decide.sweep(labelled(spark, d), best, truth(spark, d), TAUS).select("tau", F.round("macro_f05", 9).alias("macro_f05"), "n_pred")


@q("de3_denser_test", f"WITH {TRUTH}, {PREDICTED}, h AS (SELECT s1_id, o_id FROM pd WHERE p >= 0.5) SELECT s1_id, o_id FROM h UNION ALL SELECT s1_id, o_id || '_dup' FROM h WHERE o_id NOT IN (SELECT o_id FROM g)")
def de3(spark, d):
    unowned = others(spark, d).select(F.col("entity_id").alias("o_id")).join(truth(spark, d).select("o_id"), "o_id", "left_anti")
    return decide.with_duplicates(predicted(spark, d), unowned)


@q("de4_two_thresholds", f"WITH {BEST}, em AS (SELECT io FROM o WHERE coalesce(business_address, '') = '') SELECT io, i1 FROM b WHERE p >= CASE WHEN io IN (SELECT io FROM em) THEN 0.9 ELSE 0.5 END")
def de4(spark, d):
    empty = others(spark, d).filter(F.coalesce("business_address", F.lit("")) == "").select("io")
    return decide.assign_two_thresholds(scored_pairs(spark, d), empty, 0.5, 0.9)


@q("de5_matches_within_candidates", f"WITH {PRUNED}, x AS (SELECT io, i1, row_number() OVER (PARTITION BY io ORDER BY p DESC NULLS LAST, i1) AS n, p FROM s), m AS (SELECT io, i1 FROM x WHERE n = 1 AND p >= 0.5) SELECT (SELECT count(*) FROM m) AS matches, (SELECT count(*) FROM ps) AS candidates, (SELECT count(*) FROM m ANTI JOIN ps USING (io, i1)) AS outside")
def de5(spark, d):
    """Are all matches among the candidates that pruning keeps, which are listed beside them?"""
    matches, candidates = decide.assign(scored_pairs(spark, d), 0.5), pruned(spark, d).select("io", "i1")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(matches, "matches").crossJoin(one(candidates, "candidates")).crossJoin(one(matches.join(candidates, ["io", "i1"], "left_anti"), "outside"))  # one row each


@q("de6_macro_f05", f"WITH {per_entity_sql()} SELECT round(avg(f), 9) AS macro_f05 FROM f")
def de6(spark, d):
    return decide.macro_f_half(labelled(spark, d), predicted(spark, d), truth(spark, d)).select(F.round("macro_f05", 9).alias("macro_f05"))


@q(
    "de7_evaluate",
    f"""WITH {per_entity_sql()} SELECT count(*)::BIGINT AS entities, round(avg(f), 9) AS macro_f05, round(avg(CASE WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END), 9) AS macro_precision, round(avg(CASE WHEN n_true = 0 THEN 0 ELSE tp / n_true END), 9) AS macro_recall,
    round(sum(tp) / nullif(sum(n_pred), 0), 9) AS micro_precision, round(sum(tp) / nullif(sum(n_true), 0), 9) AS micro_recall, count(CASE WHEN n_pred = 0 AND n_true = 0 THEN 1 END)::BIGINT AS true_empty, count(CASE WHEN n_pred > 0 AND n_true = 0 THEN 1 END)::BIGINT AS false_positive_empty,
    count(CASE WHEN n_pred = 0 AND n_true > 0 THEN 1 END)::BIGINT AS missed_all, count(CASE WHEN n_true = 1 THEN 1 END)::BIGINT AS truth_1, count(CASE WHEN n_true = 2 THEN 1 END)::BIGINT AS truth_2, count(CASE WHEN n_true >= 3 THEN 1 END)::BIGINT AS truth_3_up, round(avg(n_pred), 9) AS avg_predicted, round(avg(n_true), 9) AS avg_true FROM f""",
)
def de7(spark, d):
    e = decide.evaluate(labelled(spark, d), predicted(spark, d), truth(spark, d))
    return e.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in e.dtypes])
