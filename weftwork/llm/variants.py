"""Variant spellings of a name (problem 4): MinHash banding over padded q-grams, Monge-Elkan, star clusters.

Distinct readings are the nodes; copies of a reading are one node. The readings of the reference names are the centres. A reading
shares a bucket with a centre if all rows of one of its bands agree; how many bands are needed follows from the collision curve
``1 - (1 - s**rows)**bands`` for the recall wanted at similarity s. Candidates are verified by Monge-Elkan similarity over words
and by their trade words, and every reading joins the star of its nearest centre.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.addresses import fold, spread
from weftwork.llm.names import Trades, distance, is_latin, name_words, reference_reading, stands_for_trade, trade_fits, trades_of, typed_readings
from weftwork.operators.cells import in_turns
from weftwork.session import drop, scoped, store

Q = 3
ROWS = 3
#: The least share of q-grams that two spellings which the verifier accepts mostly have in common: two letters changed in twelve.
AT_SIMILARITY, RECALL = 0.4, 0.9
#: Monge-Elkan similarity from which two readings are one name.
ACCEPT = 0.82
#: A trade word ends at least this share of a country's names: at most 2,000 words a country, whatever the table's size.
TRADE_SHARE = 1 / 2000


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The least number of bands whose collision curve reaches ``recall`` at ``similarity``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


BANDS = bands_for(AT_SIMILARITY, RECALL, ROWS)


def padded_grams(key: str, q: int = Q) -> set[str]:
    padded = "\x02" * (q - 1) + key + "\x03" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


def band_hashes(keys: list[str], bands: int = BANDS, rows: int = ROWS, seed: int = 11) -> np.ndarray:
    """(keys, bands) of 64-bit bucket hashes. Every different q-gram is hashed once, all rows at a time."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 2**63, size=bands * rows, dtype=np.uint64) | np.uint64(1)
    plus = rng.integers(0, 2**63, size=bands * rows, dtype=np.uint64)
    at: dict[str, int] = {}
    grams, starts = [], []
    for key in keys:
        starts.append(len(grams))
        grams += [at.setdefault(g, len(at)) for g in padded_grams(key)]
    x = np.array([xxhash.xxh64_intdigest(g) for g in at], dtype=np.uint64)
    with np.errstate(over="ignore"):
        y = x[:, None] * mult + plus
        y ^= y >> np.uint64(29)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum.reduceat((y >> np.uint64(32)).astype(np.uint32)[grams], starts, axis=0).astype(np.uint64)
        out = np.tile(np.arange(bands, dtype=np.uint64), (len(keys), 1))
        for r in range(rows):
            out = (out ^ least[:, r::rows]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def word_similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    limit = longest // 2
    return 1 - min(distance(a, b, limit), longest) / longest if longest else 1.0


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the words of the side with fewer words, by their length, of the best likeness to a run of the other's words (a word may be
    typed in pieces, or two as one); what is left over on the longer side lowers it. Runs of more than twice a word's length are
    less like it than half, so they are not looked at; sides too unlike in length to be one name are 0."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    la, lb = sum(map(len, a)), sum(map(len, b))
    fits = min(1.0, (min(la, lb) + 2) / max(la, lb))
    if fits < ACCEPT:
        return 0.0
    there = set(b)
    total = 0.0
    for w in a:
        best = 1.0 if w in there else 0.0
        for i in range(len(b) if best < 1 else 0):
            run = ""
            for x in b[i:]:
                run += x
                if len(run) > 2 * len(w):
                    break
                best = max(best, word_similarity(w, run))
        total += best * len(w)
    return total / la * fits


def likeness(typed_key: str, typed_words: str, typed_trade: str, key: str, words: str, trade: str) -> float:
    """Monge-Elkan of the words, 0 where the trade words differ. A name typed as one word may end in its trade word, in full or short."""
    if not trade_fits(typed_trade, trade):
        return 0.0
    if typed_key == key:
        return 1.0
    like = monge_elkan(typed_words.split(), words.split())
    if not typed_trade and trade and " " not in typed_words:
        if typed_key.startswith(key) and stands_for_trade(typed_key[len(key) :], trade):
            return 0.99
        like = max(like, monge_elkan([typed_key], [key + trade]))
    return like


def trade_words(reference: DataFrame) -> dict[str, list[str]]:
    """The trade words of each country: what ends at least ``TRADE_SHARE`` of its names behind different words (and three of them, as what
    fewer names end in can't be told from a name). Collected: at most 2,000 words a country by that share."""

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, w[-1], "".join(w[:-1])) for c, n in zip(pdf["country"], pdf["business_name"]) if len(w := name_words(fold(n))) > 1]
            yield pd.DataFrame(rows, columns=["country", "word", "before"])

    ends = spread(reference.filter("country IS NOT NULL").select("country", "business_name"), "business_name").mapInPandas(last, "country string, word string, before string")
    ends = store(ends.groupBy("country", "word").agg(F.countDistinct("before").alias("n")))
    total = ends.groupBy("country").agg(F.sum("n").alias("total"))
    rows = ends.join(total, "country").filter((F.col("n") >= 3) & (F.col("n") >= F.col("total") * TRADE_SHARE)).select("country", "word").collect()
    drop(ends)
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["country"], []).append(r["word"])
    return {c: sorted(w) for c, w in out.items()}


def read_names(records: DataFrame, trades: dict[str, list[str]], longest: int | None = None) -> DataFrame:
    """``name_id, country, name, latin, key, trade, words``: the readings of the different (country, business_name); those of typed names
    where ``longest``, the letters that a name like one of the reference has at most, is given."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = {c: trades_of(tuple(w)) for c, w in trades.items()}
        none = trades_of(())
        for pdf in batches:
            rows = []
            for i, c, n in zip(pdf["name_id"], pdf["country"], pdf["business_name"]):
                readings = reference_reading(n, lists.get(c, none)) if longest is None else typed_readings(n, lists.get(c, none), longest)
                rows += [(i, c, n, is_latin(n), *r) for r in readings]
            yield pd.DataFrame(rows, columns=["name_id", "country", "name", "latin", "key", "trade", "words"])

    names = spread(records.filter("country IS NOT NULL AND business_name IS NOT NULL").select("country", "business_name"), "business_name")
    names = names.withColumn("name_id", F.xxhash64("country", "business_name"))
    return names.mapInPandas(read, "name_id long, country string, name string, latin boolean, key string, trade string, words string")


#: Pairs of one bucket looked at together in Python.
TOGETHER = 1 << 20
#: Readings of a part: they stream past the centres, whose buckets each part hashes anew, so parts are few.
PART = 1 << 17


def _letters(text: str) -> int:
    """The letters of a text as bits, some sharing one."""
    bits = 0
    for c in set(text):
        bits |= 1 << (ord(c) & 63)
    return bits


class Side:
    """The readings of a table as arrays: bucket hashes, lengths and letters."""

    def __init__(self, rows: pa.Table | pa.RecordBatch):
        keys, words, trades = (rows.column(c).to_pylist() for c in ("key", "words", "trade"))
        self.rows = rows
        self.buckets = np.concatenate([band_hashes(keys[i : i + 4096]) for i in range(0, len(keys), 4096)])
        numbers = lambda of, made, kind: np.array([made(x) for x in of], dtype=kind)
        self.key, self.trade = numbers(keys, len, np.int32), numbers(trades, len, np.int32)
        self.key_letters, self.trade_letters = numbers(keys, _letters, np.uint64), numbers(trades, _letters, np.uint64)
        texts = [w.replace(" ", "") for w in words]
        self.text, self.letters = numbers(texts, len, np.int32), numbers(texts, _letters, np.uint64)
        self.words = numbers(words, lambda w: len(w.split()), np.int32)
        self.shortest = numbers(words, lambda w: min(map(len, w.split()), default=0), np.int32)


class Centres(Side):
    """A side with its buckets in order."""

    def __init__(self, rows: pa.Table):
        super().__init__(rows)
        flat = self.buckets.ravel()
        order = np.argsort(flat, kind="stable")
        self.buckets, self.owner = flat[order], (order // BANDS).astype(np.int32)


def could_be(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """Can ``likeness`` of the typed readings i of a and j of b reach ``ACCEPT``? What has no letter there is edited, so the letters
    missing on the side of fewer words bound Monge-Elkan, as the lengths do; the same for a name typed as one word with its trade. The
    likeness of two words stops short of a half, so a word that is small beside the name loses half its missing letters only."""
    least = ACCEPT - 1e-9

    def reach(n: np.ndarray, m: np.ndarray, missing: np.ndarray, shortest: np.ndarray) -> np.ndarray:
        fits = np.minimum(1.0, (np.minimum(n, m) + 2) / np.maximum(np.maximum(n, m), 1))
        lost = np.bitwise_count(missing) * np.where(shortest > 2 * (1 - least) * n, 1.0, 0.5)
        return (n - lost) * fits >= least * n

    n, m = a.text[i], b.text[j]
    x, y = a.letters[i], b.letters[j]
    few = a.words[i] <= b.words[j]
    whole = reach(np.where(few, n, m), np.where(few, m, n), np.where(few, x & ~y, y & ~x), np.where(few, a.shortest[i], b.shortest[j]))
    k, c, t = a.key[i], b.key[j], b.trade[j]
    x, y = a.key_letters[i], b.key_letters[j]
    joined = (a.trade[i] == 0) & (t > 0) & (a.words[i] == 1) & (((y & ~x == 0) & (c <= k)) | reach(k, c + t, x & ~(y | b.trade_letters[j]), k))
    return whole | joined | ((k == c) & (x == y))


def _meet(centres: Centres, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pairs that share a bucket and could be one name, each once, with both readings."""
    side = Side(rows)
    first, last = (np.searchsorted(centres.buckets, side.buckets.ravel(), s).reshape(side.buckets.shape) for s in ("left", "right"))
    upto = np.cumsum((last - first).sum(axis=1))
    begin = 0
    while begin < len(upto):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + TOGETHER, "right")))
        a, n = first[begin:end].ravel(), (last - first)[begin:end].ravel()
        i = np.repeat(np.repeat(np.arange(begin, end), BANDS), n)
        j = centres.owner[np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        near = could_be(side, i, centres, j)
        pair = np.unique(i[near] * len(centres.text) + j[near])
        i, j = pair // len(centres.text), pair % len(centres.text)
        theirs = pa.array(j)
        mine = rows.take(pa.array(i))
        columns = [mine.column("id"), *(mine.column(c) for c in ("key", "words", "trade")), *(centres.rows.column(c).take(theirs).combine_chunks() for c in ("id", "key", "words", "trade"))]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "key", "words", "trade", "centre", "c_key", "c_words", "c_trade"])
        begin = end


def _near(nodes: DataFrame, centres: DataFrame, which: str = "true") -> DataFrame:
    """``node, centre, likeness`` of the pairs of ``nodes`` and ``centres`` (both id, country, key, words, trade) that share a bucket and are one name, where ``which``
    holds for node and centre. Buckets meet in cells: chance alone gives pairs with the square of the names, and none of them is written."""
    make = lambda rows: rows.select(F.col("country").alias("zone"), "id", "key", "words", "trade")
    met = "node long, key string, words string, trade string, centre long, c_key string, c_words string, c_trade string"
    return in_turns(make(centres), make(nodes), Centres, _meet, met, part=PART, then=lambda rows: _verified(rows.filter(which)))


def _verified(full: DataFrame) -> DataFrame:
    """``node, centre, likeness`` of the pairs in ``full`` (node, key, words, trade, centre, c_key, c_words, c_trade) that are one name.

    What Monge-Elkan accepts in this order of words is so near as a whole, too (of one or two words every order is a reading of its
    own), which spares Python the pairs that met by chance."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            like = [likeness(*r) for r in zip(pdf["key"], pdf["words"], pdf["trade"], pdf["c_key"], pdf["c_words"], pdf["c_trade"])]
            out = pd.DataFrame({"node": pdf["node"], "centre": pdf["centre"], "likeness": like})
            yield out[out["likeness"] >= ACCEPT]

    words = lambda c: F.size(F.split(c, " "))
    whole = F.levenshtein("key", "c_key") <= F.least(F.length("key"), F.length("c_key")) * (1 / ACCEPT - 1) + 3
    joined = ~F.contains("words", F.lit(" ")) & (F.col("trade") == "") & (F.levenshtein("key", F.concat("c_key", "c_trade")) <= F.length("key") * (1 / ACCEPT - 1) + 3)
    full = full.filter(whole | joined | F.startswith("key", "c_key") | ((words("words") > 2) & (words("c_words") > 2)))
    return full.mapInPandas(verify, "node long, centre long, likeness double")


def link_names(reference: DataFrame, others: DataFrame, trades: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(centres, links). ``centres``: ``name_id, country, name, centre``, the star each reference name belongs to; ``links``: ``name_id,
    country, name, latin, centre, likeness``, the star of each other name that is near enough to one. A star holds the
    names of one reading; ties between equally near stars keep all."""
    trades = trades if trades is not None else trade_words(reference)
    s1 = store(read_names(reference, trades).withColumn("centre", F.xxhash64("country", "key", "trade")))
    longest = s1.agg(F.max(F.length("key") + F.length("trade")).alias("n")).first()["n"] or 0
    s3 = store(read_names(others, trades, int(longest / ACCEPT) + 3))
    centre_keys = store(s1.select("country", "key", "trade", "words", "centre").dropDuplicates(["centre"]))
    # a reading that is the centre's own collides in every band: the same node
    own = s3.join(centre_keys.select("country", "key", F.col("trade").alias("t"), "centre"), ["country", "key"])
    own = own.filter((F.col("trade") == "") | (F.col("t") == "") | F.array_contains(F.split("trade", r"\|"), F.col("t")))
    own = store(own.select("name_id", "centre", F.lit(1.0).alias("likeness")).distinct())
    open_names = s3.join(own.select("name_id").distinct(), "name_id", "left_anti")
    nodes = open_names.select("country", "key", "trade", "words").dropDuplicates(["country", "key", "trade"]).withColumn("node", F.xxhash64("country", "key", "trade"))
    nodes = store(nodes)

    near = _near(nodes.withColumnRenamed("node", "id"), centre_keys.withColumnRenamed("centre", "id"))
    stars = open_names.withColumn("node", F.xxhash64("country", "key", "trade")).select("name_id", "node").join(near, "node").groupBy("name_id", "centre").agg(F.max("likeness").alias("likeness"))
    top = F.max("likeness").over(Window.partitionBy("name_id"))
    stars = stars.withColumn("top", top).filter("likeness >= top - 1e-9").select("name_id", "centre", "likeness")
    names = s3.select("name_id", "country", "name", "latin").distinct()
    links = store(names.join(own.unionByName(stars), "name_id"))
    drop(s3, own, nodes, centre_keys)
    return s1.select("name_id", "country", "name", "centre").distinct(), links


@scoped
def variant_pairs(reference: DataFrame, others: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``s1_id, s3_id``: records of one country whose names stand for one business name and differ as stored, where the other
    name reads as Latin script. Null names, ids and countries are in no pair; repeated rows count once."""
    centres, links = link_names(reference, others)
    if labels is not None:
        reference = reference.join(labels.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_anti")
    a = reference.filter("entity_id IS NOT NULL").select(F.col("entity_id").alias("s1_id"), F.xxhash64("country", "business_name").alias("name_id"), F.col("business_name").alias("n1")).distinct()
    b = others.filter("entity_id IS NOT NULL").select(F.col("entity_id").alias("s3_id"), F.xxhash64("country", "business_name").alias("name_id"), F.col("business_name").alias("n3")).distinct()
    a = a.join(centres.select("name_id", "centre"), "name_id").select("s1_id", "n1", "centre")
    b = b.join(links.filter("latin").select("name_id", "centre"), "name_id").select("s3_id", "n3", "centre")
    return a.join(b, "centre").filter("n1 <> n3").select("s1_id", "s3_id").distinct()


def star_clusters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, star`` of every one of ``nodes`` (node) under the similarities ``edges`` (a, b): the node of most neighbours (ties: the smaller)
    is a centre and its neighbours are its satellites, then the same among those left. Nodes that lead their own neighbourhood are
    centres at once, so that a round decides far more than one; a round always decides the first of all, so rounds end by themselves."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    rank = both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.struct(F.col("n"), (-F.col("a")).alias("id")).alias("rank"))
    both = store(both.join(rank.select(F.col("a").alias("b"), F.col("rank").alias("b_rank")), "b").join(rank.withColumnRenamed("rank", "a_rank"), "a"))
    single = nodes.join(both.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.col("node").alias("star"))
    done = [store(single)]
    while not both.isEmpty():
        lead = both.groupBy("a", "a_rank").agg(F.max("b_rank").alias("top")).filter("a_rank > top").select(F.col("a").alias("star"))
        lead = store(lead)
        # a satellite of two centres goes to the one of higher rank
        with_star = both.join(lead, F.col("b") == F.col("star")).groupBy(F.col("a").alias("node")).agg(F.max_by("star", "b_rank").alias("star"))
        settled = store(with_star.unionByName(lead.select(F.col("star").alias("node"), "star")))
        done.append(settled)
        # whoever is left alone by this is a centre of its own
        gone = settled.select(F.col("node").alias("g"))
        rest = both.join(gone, F.col("a") == F.col("g"), "left_anti")
        left = store(rest.join(gone, F.col("b") == F.col("g"), "left_anti"))
        lonely = rest.select(F.col("a").alias("node")).distinct().join(left.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
        done.append(store(lonely.select("node", F.col("node").alias("star"))))
        both = left
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


@scoped
def name_stars(reference: DataFrame, others: DataFrame) -> DataFrame:
    """``country, name, star, referenced``: one row for each different name of either side. Names of the reference lead their stars; names near to none
    form stars among themselves, by the same bands, verifier and rule, so no variant is left out for lack of a reference."""
    trades = trade_words(reference)
    centres, links = link_names(reference, others, trades)
    near = links.groupBy("country", "name").agg(F.max_by("centre", F.struct("likeness", "centre")).alias("star"))
    known = centres.groupBy("country", "name").agg(F.min("centre").alias("star")).unionByName(near).groupBy("country", "name").agg(F.min("star").alias("star"))
    alone = others.select("country", F.col("business_name").alias("name")).filter("country IS NOT NULL AND name IS NOT NULL").distinct().join(known, ["country", "name"], "left_anti")
    read = store(read_names(alone.withColumnRenamed("name", "business_name"), trades, 1 << 20).withColumn("node", F.xxhash64("country", "key", "trade")))
    nodes = store(read.select("node", "country", "key", "trade", "words").dropDuplicates(["node"]))
    sides = nodes.withColumnRenamed("node", "id")
    near = _near(sides, sides, "node < centre")
    # readings of one name belong together, too
    own = read.groupBy("name_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).select("a", F.explode("all").alias("b")).filter("a <> b")
    stars = star_clusters(near.select(F.col("node").alias("a"), F.col("centre").alias("b")).unionByName(own), nodes.select("node"))
    mine = read.join(stars, "node").groupBy("country", "name").agg(F.min("star").alias("star"))
    rest = alone.join(mine, ["country", "name"], "left").withColumn("star", F.coalesce("star", F.xxhash64("country", "name")))
    return known.withColumn("referenced", F.lit(True)).unionByName(rest.withColumn("referenced", F.lit(False)))
