import math

import pytest

from weftwork.llm.mixing import common_temperature, entropy, held, mix


def test_common_temperature():
    e, w = common_temperature([0.7, 0.2, 0.1, 0.0], 1.0)
    assert sum(w) == pytest.approx(1) and w[3] == 0 and w[0] / w[1] == pytest.approx((0.7 / 0.2) ** e)
    assert entropy(w) == pytest.approx(1.0, abs=1e-6)
    e, w = common_temperature([0.7, 0.2, 0.1], 0.9, [1.0, 1.0, 0.12])
    assert w[2] == pytest.approx(0.12, abs=1e-6) and entropy(w) == pytest.approx(0.9, abs=1e-6) and w[0] / w[1] == pytest.approx((0.7 / 0.2) ** e)
    assert common_temperature([], 1.0)[1] == [] and common_temperature([0.0], 1.0)[1] == [0.0]
    assert held([0.5, 0.3, 0.2], [1.0, 0.1, 1.0]) == pytest.approx([0.9 * 5 / 7, 0.1, 0.9 * 2 / 7])
    assert held([0.5, 0.5], [0.2, 0.3]) == pytest.approx([0.2, 0.3])


@pytest.fixture
def tables(spark):
    docs = [(i, ["big", "BIG ", "Big"][i % 3], 10 + i % 7) for i in range(3000)] + [(5000 + i, "small", 20) for i in range(40)] + [(9000, None, 50), (9001, "other", 50), (9002, "small", 0)]
    targets = [("big", 0.6, 1), ("small", 0.3, 5), ("gone", 0.1, 3), (None, 0.5, 1), ("BIG", 0.1, 1)]
    return spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"), spark.createDataFrame(targets, "source_name string, target_share double, max_repeats int")


def test_mix_keeps_limits_and_reports(tables):
    docs, targets = tables
    rows, report = mix(docs, targets)
    got = rows.collect()
    sizes = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
    assert all(sizes[r["doc_id"]] == r["n_tokens"] for r in got)
    assert len({(r["doc_id"], r["pass_no"]) for r in got}) == len(got)
    assert max(r["pass_no"] for r in got if r["source"] == "small") == 5 and max(r["pass_no"] for r in got if r["source"] == "big") == 1
    by = {r["source"]: r for r in report.collect()}
    assert by["small"]["mixed_tokens"] == 4000 and by["gone"]["mixed_tokens"] == 0 and set(by) == {"big", "small", "gone"}
    assert sum(r["reached_share"] for r in by.values()) == pytest.approx(1)
    # what small can't fill goes to big
    assert by["big"]["mixed_tokens"] == pytest.approx(sum(sizes.values()) - 4000, abs=20)


def test_budget_and_interleaving(tables):
    docs, targets = tables
    rows, report = mix(docs, targets, budget=9000)
    by = {r["source"]: r for r in report.collect()}
    assert by["big"]["reached_share"] == pytest.approx(2 / 3, abs=0.01) and by["small"]["reached_share"] == pytest.approx(1 / 3, abs=0.01)
    first = [r for r in rows.collect() if r["mix_block"] < 64]
    assert sum(r["n_tokens"] for r in first if r["source"] == "big") == pytest.approx(3000, rel=0.15)


def test_temperature_mix(tables):
    """One exponent: the entropy of the targets within the limits, repeats kept, the gap to each target told."""
    docs, targets = tables
    rows, report = mix(docs, targets, budget=20_000, by="temperature")
    by = {r["source"]: r for r in report.collect()}
    assert by["big"]["exponent"] == by["small"]["exponent"] and by["gone"]["exponent"] is None
    assert entropy([by["big"]["planned_share"], by["small"]["planned_share"]]) == pytest.approx(entropy([2 / 3, 1 / 3]), abs=1e-3) or by["small"]["planned_share"] == pytest.approx(0.2)
    assert all(r["gap"] == pytest.approx(r["reached_share"] - r["target_share"]) for r in by.values())
    assert rows.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 5


def test_empty(tables, spark):
    docs, targets = tables
    assert mix(docs.limit(0), targets)[0].count() == 0
    assert mix(docs, targets.limit(0))[0].count() == 0
    assert mix(docs, targets.limit(0))[1].count() == 0
