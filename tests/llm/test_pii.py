import itertools
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from weftwork.llm.pii import LABELS, Finder, default_field, find_personal, keys_of, read_labels, replace_personal, token_features, train, viterbi
from weftwork.llm.pii_labels import labelled, templates


def test_held_out_templates():
    """Lines of other wording than those learned from: a fifth of the table's lines is held out."""
    rng = random.Random(4)
    table = sorted(set(templates()))
    rng.shuffle(table)
    cut = len(table) // 5
    finder = Finder(train(labelled(12, 1, table[cut:])))
    held = read_labels(labelled(4, 2, table[:cut]))
    want = {(i, k, s) for i, (_, spans) in enumerate(held) for k, s, _ in spans}
    got = {(i, k, s) for i, spans in enumerate(finder.spans([t for t, _ in held])) for k, s, _ in spans}
    assert len(want & got) / len(want) > 0.92 and len(want & got) / len(got) > 0.94


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_no_labelled_line_is_in_a_test_table(sf):
    """Nor is any labelled span or family name in a text that is scored."""
    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not here")
    table = read_labels(labelled())
    texts = [t for t in pq.read_table(path, columns=["text"])["text"].to_pylist() if t]
    lines = {line.strip() for t in texts for line in t.split("\n")}
    told = [(t, spans) for t, spans in table if spans]
    assert sum(t.strip() in lines for t, _ in told) == 0
    if sf == "sf0.1":
        return  # each of thousands of spans against the whole text takes too long here
    whole = "\n".join(texts)
    people = {t[s:e] for t, spans in told for k, s, e in spans if k in ("person", "email", "street_address")}
    assert sum(p in whole for p in people) == 0


def test_patterns_of_long_numbers():
    keys, spans = keys_of("tel 614-555-0142 or 43,582")
    assert [k.partition("\x04")[2] for k in keys] == ["", "3-3-4/0", "", "3-3-4/1", "", "3-3-4/2", "", "", "", ""]
    assert "g=3-3-4/1" in token_features(keys[3], set()) and "n=10" in token_features(keys[1], set()) and "s=d3" in token_features(keys[1], set())


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    score, move, first = rng.normal(size=(3, 5, 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    lengths = np.array([5, 4, 2])
    got = viterbi(score, lengths, move, first)
    for i, n in enumerate(lengths):
        best = max(itertools.product(range(4), repeat=int(n)), key=lambda p: first[p[0]] + sum(score[i, t, y] for t, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[i, :n]) == best


def test_spans_do_not_depend_on_company():
    texts = [t for t, _ in read_labels(labelled(1))][:60]
    finder = Finder(default_field())
    together = finder.spans(["\n".join(texts)])[0]
    alone, at = [], 0
    for t in texts:
        alone += [(k, at + s, at + e) for k, s, e in Finder.spans(finder, [t])[0]]
        at += len(t) + 1
    assert together == alone
    assert len(LABELS) == 11


def test_rows(spark):
    text = "😀 Contact: joyce.tohurst@post.lebi.test, tel. +44 1632 960459\nHis SSN is 666-11-4436, lol\n* Doris Khimuman, painter"
    long = "Part of it belongs to Saint Deyi parish. " * 5000 + "* Doris Khimuman, painter"
    df = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "", "c"), (4, "  ", "d"), (1, text, "a"), (5, long, "e")], "doc_id long, text string, kind string")
    rows = find_personal(df).collect()
    got = [(r["doc_id"], r["kind"], r["start_pos"]) for r in rows]
    first = [("email", text.index("joyce") + 1), ("phone", text.index("+44") + 1), ("national_id", text.index("666") + 1), ("person", text.index("Doris") + 1)]
    assert sorted(got) == sorted([(1, k, s) for k, s in first] * 2 + [(5, "person", long.index("Doris") + 1)])
    clean = {r["doc_id"]: r["text"] for r in replace_personal(df).collect()}
    assert clean[1] == "😀 Contact: [EMAIL], tel. [PHONE]\nHis SSN is [NATIONAL_ID], lol\n* [PERSON], painter"
    assert clean[2] is None and clean[3] == "" and clean[4] == "  "
    assert find_personal(df.limit(0)).count() == 0
    assert len(long) == pytest.approx(205_000, rel=0.01)
