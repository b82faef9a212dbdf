import random

import pytest

from weftwork.operators import decide


def f_half(truth, pred):
    if not truth and not pred:
        return 1.0
    tp = len(truth & pred)
    if not tp:
        return 0.0
    p, r = tp / len(pred), tp / len(truth)
    return 1.25 * p * r / (0.25 * p + r)


def frames(spark, truth, pred):
    ids = spark.createDataFrame([(k,) for k in truth], "s1_id string")
    pairs = lambda d: spark.createDataFrame([(k, o) for k, v in d.items() for o in v], "s1_id string, o_id string")
    return ids, pairs(pred), pairs(truth)


@pytest.mark.parametrize(
    "truth,pred,want",
    [({"S2-47", "S3-812"}, {"S2-47", "S2-193", "S3-812"}, 0.7142857), (set(), set(), 1), (set(), {"x"}, 0), ({"x"}, set(), 0), ({"a"}, {"b"}, 0), ({"a", "b"}, {"a"}, 0.8333333)],
)
def test_worked_examples(spark, truth, pred, want):
    ids, p, t = frames(spark, {"e": truth}, {"e": pred})
    assert decide.macro_f_half(ids, p, t).first()[0] == pytest.approx(want, abs=1e-6)


def test_perturbed_truth_against_sets(spark):
    rng = random.Random(0)
    truth = {f"S1-{i}": {f"o{rng.randrange(500)}" for _ in range(rng.randrange(4))} for i in range(300)}
    pred = {k: {o for o in v if rng.random() > 0.2} | ({f"x{rng.randrange(99)}"} if rng.random() < 0.15 else set()) for k, v in truth.items()}
    ids, p, t = frames(spark, truth, pred)
    want = sum(f_half(truth[k], pred[k]) for k in truth) / len(truth)
    assert decide.macro_f_half(ids, p.union(p), t).first()[0] == pytest.approx(want, abs=1e-9)
    assert decide.evaluate(ids, p, t).first()["macro_f05"] == pytest.approx(want, abs=1e-9)


def test_assign_ties_and_threshold(spark):
    s = spark.createDataFrame([(1, 2, 0.9), (1, 1, 0.9), (2, 1, 0.5), (3, 1, 0.49), (4, 1, None)], "io long, i1 long, p double")
    assert {tuple(r) for r in decide.assign(s, 0.5).collect()} == {(1, 1), (2, 1)}
    empty = spark.createDataFrame([(2,)], "io long")
    assert {tuple(r) for r in decide.assign_two_thresholds(s, empty, 0.4, 0.9).collect()} == {(1, 1), (3, 1)}
    assert decide.assign(s.limit(0), 0.5).count() == 0
