import os
import time

import pytest
from pyspark.sql import functions as F

from weftwork import session
from weftwork.llm import linkage
from weftwork.operators import blocking, cells


def shuffles(spark):
    """The shuffle files there are."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def left_over(spark, before):
    """What shuffle files are new, once those being removed are gone."""
    for _ in range(40):
        if not (new := shuffles(spark) - before):
            break
        time.sleep(0.25)
    return new


def stored(spark):
    at = session._ensure_checkpoint_dir(spark).removeprefix("file:")
    return {f for _, names, _ in os.walk(at) for f in names if f.startswith("stored-")}


def records(spark, side, n):
    rows = [(f"{side}-{i}", f"Roju{chr(97 + i % 7)}sanago{i % 11} Foods", f"{i} Polokade Street, Setroville, Oregon", "US") for i in range(n)]
    return spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")


def test_linkage_leaves_its_result_only(spark):
    """shuffles and tables in between are gone when the links are there, and the setting is as before."""
    before = shuffles(spark)
    rows = linkage.link_records(records(spark, "S1", 60), records(spark, "S3", 90))
    assert not left_over(spark, before) and not stored(spark)
    assert spark.conf.get(session.RELEASE, None) is None
    assert rows.filter("address_level = 4").count() == 60


def test_store_is_smaller_than_a_checkpoint(spark):
    sizes = []

    @session.scoped
    def made(rows):
        kept = session.store(rows)
        at = kept._stored.removeprefix("file:")
        sizes.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(at) for f in names))
        assert kept.count() == 50_000
        session.drop(kept)
        assert not os.path.exists(at)
        return rows.limit(7)

    assert made(spark.range(50_000).withColumn("word", F.lit("polokade"))).count() == 7
    assert sizes[0] < 50_000 * 16 and not stored(spark)  # a checkpoint has 40 bytes a row


def test_scope_ends_with_an_error(spark):
    @session.scoped
    def fails(rows):
        session.store(rows)
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        fails(spark.range(5))
    assert not stored(spark) and spark.conf.get(session.RELEASE, None) is None


def texts(spark, name, n):
    return spark.range(n).select(F.col("id").alias(name), F.lit("US").alias("country"), F.concat(F.lit("polo"), F.conv(F.hash("id") % (n // 2), 10, 26), F.lit(" sanago")).alias("text"))


def test_text_candidates_are_dealt_in_turns(spark, monkeypatch):
    """as the parts of one country grow, its reference isn't shuffled to all of them at once."""
    a, b = texts(spark, "i1", 300), texts(spark, "io", 900)
    find = lambda: sorted(map(tuple, blocking.tfidf_candidates(a, b, top_n=2, max_df=0.5, min_sim=0.2).collect()))
    whole = find()
    dealt, plain = [], cells.beside

    def seen(*args):
        dealt.append(args[-1])
        return plain(*args)

    monkeypatch.setattr(cells, "beside", seen)
    monkeypatch.setattr(cells, "LEAST", 64)
    monkeypatch.setattr(cells, "TURN_LEAST", 1)
    monkeypatch.setattr(cells, "TURN", 1)
    before = shuffles(spark)
    assert find() == whole and len(whole) > 900
    assert len(dealt) > 1 and [k for k, _ in dealt] == list(range(len(dealt)))
    assert len(left_over(spark, before)) <= 8  # of the counts; none of the cells


def test_no_rows_no_turns(spark):
    empty = texts(spark, "io", 10).limit(0)
    assert blocking.tfidf_candidates(texts(spark, "i1", 10), empty).count() == 0
