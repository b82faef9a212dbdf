"""Record linkage without keys (problem 3): several blocking passes, agreement levels, expectation-maximisation.

Blocks are the stars of the names (one pass) and the buildings of the addresses (another). A pair in a block has a level of agreement
for its names and one for its addresses. How often levels occur together is counted over all pairs of all blocks; expectation-maximisation
on these counts gives the probability of each level among matches and among others, and both the posterior of each pair. The
posterior is divided among the reference records that a record fits equally well, so that it is a confidence in that one.

Blocks are counted, not expanded: what pairs of a star are of one building, or of one street or town, comes from joins on both at
once; of the others only their number matters, and for a record without a building that it has them. So a star or a building with a third
of all records costs its rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.addresses import fold, match_buildings, spread
from weftwork.llm.names import ALIAS, DOMAIN, HANDLE, Trades, name_words, reference_reading, tokens_of, trades_of, transliterate, typed_readings
from weftwork.llm.variants import link_names, trade_words, word_similarity
from weftwork.session import drop, scoped, store

#: Levels of names: 0 different, 1 alike in sound, 2 one star but nearly spelt alike, 3 one star, 4 and 5 the same where the star holds
#: one reference record only: a rare name says more.
#: Levels of addresses: 0 a building elsewhere, 1 no building named and nothing in common, 2 no address, 3 no building named but street or
#: town in common, 4 the same building.
NAME_LEVELS, ADDRESS_LEVELS = 6, 5
#: Likeness by sound from which names are of level 1.
ALIKE = 0.8
SOUNDS = [(re.compile(p), r) for p, r in (("ph", "f"), ("[ckq]h?", "k"), ("(?:sh|z)", "s"), ("w", "v"), ("(?:ee|y)", "i"), ("oo", "u"), ("([bdgjt])h", r"\1"), (r"(.)\1+", r"\1"))]


def sound(word: str) -> str:
    for pattern, to in SOUNDS:
        word = pattern.sub(to, word)
    return word


def sounds_alike(clean: str | None, typed: str | None) -> float:
    """Likeness by sound of the words of the clean name to runs of words of the typed one, either side of an alias; 0 to 1."""
    want = [sound(w) for w in name_words(fold(clean))]
    text = transliterate(fold(typed)).strip(" *#-<>\"")
    if not want or not text:
        return 0.0
    m = DOMAIN.match(text) or HANDLE.match(text)
    best = 0.0
    for part in [m[1]] if m else ALIAS.split(" " + text + " "):
        have = [sound(w) for w in tokens_of(part)]
        joined = "".join(have)
        said = want[: max(1, len(want) - 1)]
        whole = "".join(said)
        if len(whole) >= 5 and whole in joined:
            return 1.0
        score = 0.0
        for w in said:
            like = 0.0
            for i in range(len(have)):
                run = ""
                for x in have[i:]:
                    run += x
                    if len(run) > 2 * len(w):
                        break
                    like = max(like, word_similarity(w, run))
            score += like * len(w)
        best = max(best, score / max(1, len(whole)))
    return best


def mixture(counts: np.ndarray, u: np.ndarray, steps: int = 300) -> np.ndarray:
    """Level probabilities m of matches, by expectation-maximisation on the level counts of one block, the others' u being known."""
    u = np.maximum(u, 1e-12) / np.maximum(u, 1e-12).sum()
    m = np.linspace(0.02, 1.0, len(u)) ** 2
    m, share, total = m / m.sum(), 0.5, max(counts.sum(), 1.0)
    for _ in range(steps):
        post = share * m / np.maximum(share * m + (1 - share) * u, 1e-300)
        w = counts * post
        share = float(np.clip(w.sum() / total, 1e-6, 1 - 1e-6))
        m = (w + 1e-3) / (w.sum() + len(u) * 1e-3)
    return m


def expectation_maximisation(counts: np.ndarray, u_name: np.ndarray, u_addr: np.ndarray, total: float, steps: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(posterior of each cell, m of names, m of addresses, share of matches among all ``total`` pairs) for ``counts`` (name levels,
    address levels) of the pairs in blocks. A block agrees on its own field by construction, so the m of a field starts from the block of the
    other: names within buildings, addresses within stars. Then both steps run over all cells: every cell's posterior under m, u and the
    share; from these the share of matches, and u of the pairs in blocks that are none (never below what all pairs give)."""
    m_name, m_addr = mixture(counts[:, -1], u_name), mixture(counts[2:].sum(axis=0), u_addr)
    base_name, base_addr, share = u_name.copy(), u_addr.copy(), 1e-4
    post = np.zeros_like(counts)
    for _ in range(steps):
        odds = share / (1 - share) * (m_name / np.maximum(u_name, 1e-12))[:, None] * (m_addr / np.maximum(u_addr, 1e-12))[None, :]
        post = odds / (1 + odds)
        match, other = counts * post, counts * (1 - post)
        share = float(np.clip(match.sum() / max(total, 1.0), 1e-12, 0.5))
        # names of other pairs within stars, addresses of other pairs within buildings: spread over all pairs
        u_name = np.maximum(base_name, np.r_[0.0, 0.0, other[2:].sum(axis=1) / max(total, 1.0)])
        u_addr = np.maximum(base_addr, np.r_[[0.0] * (ADDRESS_LEVELS - 1), other[:, -1].sum() / max(total, 1.0)])
    return post, m_name, m_addr, share


def _hear(pairs: DataFrame, trades: dict[str, list[str]]) -> DataFrame:
    """``pairs`` (country, n1, n3, ...) with ``alike``: do the names sound alike, without another trade word?"""
    schema = T.StructType([*pairs.schema.fields, T.StructField("alike", T.BooleanType())])

    def hear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists, none = {c: trades_of(tuple(w)) for c, w in trades.items()}, trades_of(())
        for pdf in batches:
            pdf["alike"] = [sounds_alike(x, y) >= ALIKE and not other_trade(x, y, lists.get(c, none)) for c, x, y in zip(pdf["country"], pdf["n1"], pdf["n3"])]
            yield pdf

    return pairs.mapInPandas(hear, schema)


def compare(reference: DataFrame, others: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, float]:
    """(candidates, counts, u of names, u of addresses, number of all pairs of a country).

    ``candidates``: ``s3_id, s1_id, name_level, address_level, ties``: for a record the reference records of its star at its building; else those
    that sound alike there; where it names no building, those of its star in a street or town it says, else one (the smallest) for all of its star.
    ``ties`` is how many it stands for. ``counts``: all pairs of all stars and buildings by (name level, address level)."""
    trades = trade_words(reference)
    centres, links = link_names(reference, others, trades)
    found = match_buildings(reference, others)
    cols = ["entity_id", "country", "business_name", "business_address"]
    ref = reference.filter("entity_id IS NOT NULL AND country IS NOT NULL").select(cols).dropDuplicates(["entity_id"])
    oth = others.filter("entity_id IS NOT NULL AND country IS NOT NULL").select(cols).dropDuplicates(["entity_id"])
    name_id = F.xxhash64("country", "business_name").alias("name_id")

    # both sides once: stars of names, buildings of addresses
    one_site = found.members.groupBy("s1_id").agg(F.min("site").alias("site"))
    left = ref.select(F.col("entity_id").alias("s1_id"), "country", name_id).join(one_site, "s1_id", "left").join(found.sites.select("site", "street", "town"), "site", "left")
    left = store(left.join(centres.groupBy("name_id").agg(F.collect_set("centre").alias("centres")), "name_id", "left"))
    says = found.addresses.join(found.placed.groupBy("aid").agg(F.collect_set("site").alias("sites")), "aid", "left")
    named = F.col("num").isNotNull() & F.col("several")
    says = says.select("aid", named.alias("named"), F.coalesce("some", F.lit(False)).alias("some"), "sites", F.array_union("streets", "towns").alias("parts"))
    right = oth.select(F.col("entity_id").alias("s3_id"), "country", name_id, F.xxhash64("country", "business_address").alias("aid")).join(says, "aid", "left")
    stars = links.groupBy("name_id").agg(F.collect_set("centre").alias("centres"), (F.max("likeness") >= 0.99).alias("same"))
    right = store(right.join(stars, "name_id", "left"))

    star1 = left.select("s1_id", "site", "street", "town", F.explode("centres").alias("centre"))
    star3 = right.select("s3_id", "named", "some", "same", "sites", "parts", F.explode("centres").alias("centre"))
    size1 = star1.groupBy("centre").agg(F.countDistinct("s1_id").alias("n1"), F.min("s1_id").alias("first"))
    level = F.when(F.col("same"), 3).otherwise(2) + F.when(F.col("n1") == 1, 2).otherwise(0)
    star3 = store(star3.join(size1, "centre").withColumn("name_level", level))
    # reference records that a star has at one building are one row, for which the smallest stands
    heads = lambda *by: star1.groupBy("centre", *by).agg(F.countDistinct("s1_id").alias("ties"), F.min("s1_id").alias("s1_id"))
    fold = lambda rows, at: rows.groupBy("s3_id", "s1_id").agg(F.max("name_level").alias("name_level"), F.max("ties").alias("ties")).withColumn("address_level", F.lit(at))
    both = store(fold(star3.select("s3_id", "name_level", "centre", F.explode("sites").alias("site")).join(heads("site"), ["centre", "site"]), 4))
    # a record without a building may say where: in the street or town of some of its star
    vague = star3.filter("NOT coalesce(named, false) AND sites IS NULL").select("s3_id", "centre", "name_level", "some", "parts", "n1", "first")
    part = F.explode(F.array_distinct(F.array("street", "town"))).alias("part")
    spots = star1.select("centre", "s1_id", part).filter("part IS NOT NULL").groupBy("centre", "part").agg(F.countDistinct("s1_id").alias("ties"), F.min("s1_id").alias("s1_id"))
    near = store(fold(vague.select("s3_id", "name_level", "centre", F.explode("parts").alias("part")).join(spots, ["centre", "part"]), 3))
    alone = vague.join(near.select("s3_id").distinct(), "s3_id", "left_anti").groupBy("s3_id").agg(
        F.max("name_level").alias("name_level"), F.max(F.when(F.col("some"), 1).otherwise(2)).alias("address_level"), F.sum("n1").alias("ties"), F.min("first").alias("s1_id"))

    # names at one building that share no star there are compared by sound, and, to know how often others sound alike, with those of another
    rest = store(right.filter("sites IS NOT NULL").join(both.select("s3_id").distinct(), "s3_id", "left_anti").select("s3_id", "country", "name_id", F.explode("sites").alias("site")))
    shelf = Window.partitionBy("country", F.pmod(F.xxhash64("site"), F.lit(1 << 20)) % F.greatest(F.lit(1), F.col("shelves"))).orderBy("site")
    shelves = found.sites.groupBy("country").agg(F.ceil(F.count(F.lit(1)) / 16).alias("shelves"))
    others_at = found.sites.select("country", "site").join(shelves, "country").withColumn("other", F.lead("site").over(shelf)).filter("other IS NOT NULL").select("site", "other")
    tries = rest.select("country", "name_id", "site", F.lit(True).alias("here"), F.col("site").alias("at")).unionByName(rest.join(others_at, "site").select("country", "name_id", "site", F.lit(False).alias("here"), F.col("other").alias("at")))
    tries = store(tries.distinct())
    names1 = ref.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("n1")).join(found.members, "s1_id").groupBy(F.col("site").alias("at"), "n1").agg(F.collect_set("s1_id").alias("ids"))
    names3 = oth.select(name_id, F.col("business_name").alias("n3")).dropDuplicates(["name_id"])
    heard = spread(tries.join(names1, "at").join(names3, "name_id").select("name_id", "site", "here", "country", "n1", "n3", "ids"), "name_id")
    heard = store(_hear(heard, trades))
    sound = rest.join(heard.filter("here AND alike").select("name_id", "site", F.explode("ids").alias("s1_id")), ["name_id", "site"]).select("s3_id", "s1_id", F.lit(1).alias("name_level"), F.lit(4).alias("address_level")).distinct()
    cols = ["s3_id", "s1_id", "name_level", "address_level", "ties"]
    candidates = store(both.select(cols).unionByName(sound.withColumn("ties", F.lit(1).cast("long")).select(cols)).unionByName(near.select(cols)).unionByName(alone.select(cols)))
    drop(both, near, rest, tries)

    # a job a count, as the driver holds the plans of all that runs at once; what comes back is a row a pair of levels
    row = lambda what, i, j, n: (F.lit(what).alias("what"), i.cast("int").alias("i"), j.cast("int").alias("j"), n.cast("double").alias("n"))
    placed = candidates.filter("address_level >= 3").groupBy("name_level", "address_level").agg(F.sum("ties").alias("n")).select(*row("cell", F.col("name_level"), F.col("address_level"), F.col("n")))
    where = F.when(F.coalesce("named", F.lit(False)) | F.col("sites").isNotNull(), 0).when(F.col("some"), 1).otherwise(2).alias("w")
    starred = star3.groupBy("name_level", where).agg(F.sum("n1").alias("n")).select(*row("star", F.col("name_level"), F.col("w"), F.col("n")))
    at_site = found.members.groupBy("site").agg(F.count(F.lit(1)).alias("n1")).join(right.select(F.explode("sites").alias("site")).groupBy("site").agg(F.count(F.lit(1)).alias("n3")), "site")
    together = at_site.agg(F.sum(F.col("n1") * F.col("n3")).alias("n")).select(*row("site", F.lit(0), F.lit(0), F.col("n")))
    chance = heard.filter("NOT here").groupBy("alike").agg(F.count(F.lit(1)).alias("n")).select(*row("chance", F.col("alike"), F.lit(0), F.col("n")))
    # how the levels fall among all pairs of a country, matched or not
    kinds = right.groupBy("country").agg(F.count(F.lit(1)).alias("n3"), F.avg(F.coalesce("named", F.lit(False)).cast("double")).alias("named"), F.avg((~F.coalesce("named", F.lit(False)) & F.coalesce("some", F.lit(False))).cast("double")).alias("some"))
    sides = left.groupBy("country").agg(F.count(F.lit(1)).alias("n1"), F.greatest(F.countDistinct("town"), F.lit(1)).alias("towns"))
    every = F.col("n1").cast("double") * F.col("n3")
    falls = kinds.join(sides, "country").select(F.explode(F.array(*[F.struct(*row("all", F.lit(i), F.lit(0), x)) for i, x in enumerate((every, every * F.col("named"), every * F.col("some") / F.col("towns"), every * F.col("some")))])).alias("x")).select("x.*").groupBy("what", "i", "j").agg(F.sum("n").alias("n"))
    counts = np.zeros((NAME_LEVELS, ADDRESS_LEVELS))
    tried, pairs_at_sites, shares = [0.0, 0.0], 0.0, [0.0] * 4
    for r in (r for rows in (placed, starred, together, chance, falls) for r in rows.collect()):  # at most 40 rows
        n = r["n"] or 0.0
        if r["what"] in ("cell", "star"):
            counts[r["i"], r["j"]] += n
        elif r["what"] == "site":
            pairs_at_sites = n
        elif r["what"] == "chance":
            tried[r["i"]] += n
        else:
            shares[r["i"]] = n
    drop(left, right, star3, heard)
    counts[2:, 0] = np.maximum(counts[2:, 0] - counts[2:, 4], 0)
    counts[2:, 1] = np.maximum(counts[2:, 1] - counts[2:, 3], 0)
    counts[0, 4] = max(0.0, pairs_at_sites - counts[1:, 4].sum())
    total = shares[0] or 1.0
    named_share, near_share, some_share = (x / total for x in shares[1:])
    u_addr = np.maximum([named_share, some_share - near_share, 1 - named_share - some_share, near_share, counts[:, -1].sum() / total], 1e-9)
    # pairs of one star at named buildings elsewhere are no matches: they tell how often others share a star
    u_name = np.array([0.0, (tried[1] + 0.5) / (sum(tried) + 1.0), *((counts[2:, 0] + 1) / (u_addr[0] * total))])
    u_name[0] = max(1 - u_name.sum(), 1e-9)
    return candidates, counts, u_name, u_addr, total


def other_trade(clean: str, typed: str, trades: Trades) -> bool:
    """Does the typed name say a trade word while the clean one has another?"""
    own = {t for _, t, _ in reference_reading(clean, trades)}
    if not own or "" in own:
        return False
    said = {t for _, ts, _ in typed_readings(typed, trades) if ts for t in ts.split("|")}
    text = fold(typed)
    m = DOMAIN.match(text) or HANDLE.match(text)
    if m:
        said |= {t for t in trades.words if len(t) > 5 and m[1].endswith(t)}
    return bool(said) and not own & said


@scoped
def link_records(reference: DataFrame, others: DataFrame) -> DataFrame:
    """``s1_id, s3_id, name_level, address_level, ties, confidence``: for every record that has a candidate its best one. Where several reference
    records fit equally well, the smallest stands for them, ``ties`` says how many they are, and the confidence is divided by them.

    A record of null id or country is in no pair; null and empty names and addresses count as missing; redelivered records count once."""
    candidates, counts, u_name, u_addr, total = compare(reference, others)
    post = expectation_maximisation(counts, u_name, u_addr, total)[0]
    table = candidates.sparkSession.createDataFrame([(i, j, float(post[i, j])) for i in range(NAME_LEVELS) for j in range(ADDRESS_LEVELS)], "name_level int, address_level int, posterior double")
    scored = candidates.join(F.broadcast(table), ["name_level", "address_level"])
    rank = F.struct("posterior", (F.col("name_level") + F.col("address_level")).alias("levels"))
    best = scored.groupBy("s3_id", rank.alias("rank"), "name_level", "address_level").agg(F.min("s1_id").alias("s1_id"), F.sum("ties").alias("ties"))
    best = best.groupBy("s3_id").agg(F.max_by(F.struct("s1_id", "name_level", "address_level", "ties", "rank.posterior"), F.struct("rank", "name_level")).alias("x"))
    return best.select("x.s1_id", "s3_id", "x.name_level", "x.address_level", "x.ties", (F.col("x.posterior") / F.col("x.ties")).alias("confidence"))


def linked(reference: DataFrame, others: DataFrame, labels: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``s1_id, s3_id`` with a confidence above ``least``."""
    rows = link_records(reference, others).filter(F.col("confidence") > least)
    if labels is not None:
        rows = rows.join(labels.select(F.col("source1_entity_id").alias("s1_id")), "s1_id", "left_anti")
    return rows.select("s1_id", "s3_id").distinct()
