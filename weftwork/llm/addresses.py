"""Postal addresses of one building written differently (problem 1).

A building of the reference side is a house number, a street and a town. An address of the other side is a house number and runs of
words. It is placed where it says number, street and town of one building, or, where it says no town, number and street (and
state, if it says one) of a single one. Words that say nothing known may be rewritten, but only by what is mined:

* spelling: a run of unknown words and a street (or town) of the list that are near in spelling and meet in addresses agreeing
  elsewhere: on number and town, on number and street, on number and state, or at least on the number;
* abbreviations, of any spelling: a run of unknown words and a state or a street type that meet in addresses placed already.

A pair is kept if it meets significantly more often than chance gives (likelihood ratio over all compared addresses of its kind).
Kept pairs normalise the addresses again, which are matched again, until a round keeps no new pair. No other lookup adds
a match: without mining only addresses spelt as in the list are placed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.lookalikes import transducer
from weftwork.session import drop, scoped, shuffle_width, store

#: Words before the number or letter of a room inside the building, and those that stand before a landmark.
INSIDE = re.compile(
    r"\b(?:unit|apt|apartment|suite|ste|floor|flr|fl|room|rm|flat|door|level|etage|etg|bat|batiment|appt|porte|esc|escalier|po box|p o box|box)\b[\s.:]*(?:#|no\b|n°|º)?[\s.:]*(?:\d+[a-z]?|[a-z])\b"
    r"|\b\d+(?:st|nd|rd|th|e|er|eme)\s+(?:floor|etage)\b"
)
#: The word for the house number itself, which INSIDE must not take for a room.
HOUSE = re.compile(r"\b(?:door|plot|house|h|shop|gate)\s*\.?\s*(?:no|number|num|n°)\b[\s.:]*|\b(?:no|n°|numero)[\s.:]+(?=\d)|#(?=\s*\d)")
#: A landmark ends at a comma or number; where none follows, town and state may, and only the word before it is left out.
LANDMARK = re.compile(r"\b(?:near|behind|opp|opposite|beside|next to|adjacent to|in front of)\b\.?(?:\s+[^,\d]*(?=[,\d]))?")
STREET_WORDS = frozenset(
    "road street avenue lane drive court boulevard parkway place square terrace way circle highway close crescent"
    " nagar marg colony sector layout path chowk bazaar rue impasse allee chemin quai cours route".split()
)
MISSING = frozenset(["", "na", "n/a", "null", "none"])
#: Likelihood ratios beyond which chance is left out, at one degree of freedom: one in a thousand where any two words may meet, one
#: in twenty where nearness in spelling leaves a word with one or two words to be tested against.
SIGNIFICANT, SIGNIFICANT_NEAR = 10.83, 3.84


def fold(text: str | None) -> str:
    """Consistent form, lower case, without accents on Latin letters."""
    if not text:
        return ""
    text = transducer()(text).lower()
    if text.isascii():
        return text
    out = []
    for c in unicodedata.normalize("NFD", text):
        if unicodedata.category(c) == "Mn" and not ("ऀ" <= c <= "෿"):
            continue
        out.append(c)
    return "".join(out)


def _words(part: str) -> list[str]:
    # hyphens inside a word join it; anything else that is no letter, mark or digit separates
    return re.sub(r"[^\wऀ-෿]+|_", " ", re.sub(r"(?<=\w)[-'’](?=\w)", "", part)).split()


def _number(raw: str) -> str:
    return raw.lstrip("0") or "0"


def parse_reference(address: str | None) -> tuple[str, str, str, str, str] | None:
    """(number, street, type, town, state) of a clean address; None if it names no building. The parts are told by the commas:
    the one with the house number holds the street or stands before it, and the last two without number are town and state."""
    text = INSIDE.sub(" ", HOUSE.sub(" ", fold(address)))
    parts = [p.strip() for p in text.split(",") if p.strip()]
    at = next((i for i, p in enumerate(parts) if p[0].isdigit()), None)
    if at is None:
        return None
    m = re.match(r"(\d+[a-z]?)\b\s*", parts[at])
    if not m:
        return None
    street, rest = parts[at][m.end() :], parts[:at] + parts[at + 1 :]
    if not street and at < len(parts) - 1:
        street, rest = parts[at + 1], parts[:at] + parts[at + 2 :]
    words = _words(street)
    kind = next((w for w in (words[-1:] + words[:1]) if w in STREET_WORDS), "") if len(words) > 1 else ""
    if kind:
        words.remove(kind)
    rest = ["".join(_words(p)) for p in rest]
    if not words or not rest:
        return None
    return _number(m[1]), "".join(words), kind, rest[-2] if len(rest) > 1 else rest[-1], rest[-1] if len(rest) > 1 else ""


def parse_free(address: str | None) -> tuple[str | None, list[str]]:
    """House number (None if there is none) and the words of an address as typed, rooms and landmarks left out."""
    text = fold(address).strip()
    if text in MISSING:
        return None, []
    text = LANDMARK.sub(" ", INSIDE.sub(" , ", HOUSE.sub(" ", text)))
    # a number right before another one is that of a room
    number = re.search(r"(?<![\w])(\d+[a-z]?)(?!\w)(?![\s,]*\d)", text)
    return (_number(number[1]) if number else None), [w for w in _words(text) if not w[0].isdigit()]


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """The different rows over as many tasks as a shuffle has: what follows costs Python time, which the size in bytes that adaptive
    execution merges tasks by doesn't tell."""
    return rows.repartition(shuffle_width(rows.sparkSession), *by).distinct()


def reference_buildings(records: DataFrame) -> DataFrame:
    """``id, country, num, street, kind, town, state`` of the different clean addresses that name a building."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, c, *p) for i, c, a in zip(pdf["entity_id"], pdf["country"], pdf["business_address"]) if (p := parse_reference(a))]
            yield pd.DataFrame(rows, columns=["id", "country", "num", "street", "kind", "town", "state"])

    rows = spread(records.select("entity_id", "country", "business_address").filter("entity_id IS NOT NULL AND country IS NOT NULL"), "entity_id")
    return rows.mapInPandas(parse, "id string, country string, num string, street string, kind string, town string, state string")


def runs_of(words: list[str], longest: int) -> list[str]:
    """Every run of words, joined, of at most ``longest`` letters: a name may be typed in pieces or have several words."""
    out = {}
    for i in range(len(words)):
        joined = ""
        for w in words[i:]:
            joined += w
            if len(joined) > longest:
                break
            out[joined] = None
    return list(out)


def unknown_runs(words: list[str], known: set[str], longest: int) -> list[str]:
    """The runs, joined, of words that are in no run of ``known``, as long as one near in spelling to an entry of at most ``longest``
    letters can be."""
    told = [False] * len(words)
    for i in range(len(words)):
        joined = ""
        for j in range(i, len(words)):
            joined += words[j]
            if len(joined) > longest:
                break
            if joined in known:
                told[i : j + 1] = [True] * (j + 1 - i)
    out = {}
    for i in range(len(words)):
        joined = ""
        for j in range(i, len(words)):
            joined += words[j]
            if told[j] or len(joined) > longest + edits(longest):
                break
            out[joined] = None
    return list(out)


def edits(length: int) -> int:
    """Edits up to which a word is near in spelling to an entry of this length."""
    return 1 if length < 5 else 2 if length < 12 else 3


def _pieces(length: int) -> list[tuple[int, int]]:
    """An entry cut into one piece more than it may have edits: one of them is left whole in every word near to it."""
    n = edits(length) + 1
    ends = [length * i // n for i in range(n + 1)]
    return [(s, e - s) for s, e in zip(ends, ends[1:])]


def entry_pieces(entry: str) -> list[str]:
    return [f"{len(entry)}.{i}.{entry[s : s + w]}" for i, (s, w) in enumerate(_pieces(len(entry)))]


def word_pieces(word: str, lengths: frozenset[int] | None = None) -> list[str]:
    """The pieces by which a word meets every entry near to it, of the ``lengths`` that entries have: where piece i stands whole, at most
    i edits lie before it and the others behind it, which bounds how far it has moved."""
    n, out = len(word), {}
    for length in range(max(1, n - 3), n + 4):
        k, more = edits(length), n - length
        if abs(more) > k or (lengths is not None and length not in lengths):
            continue
        for i, (s, w) in enumerate(_pieces(length)):
            for p in range(max(0, s - i, s + more - (k - i)), min(n - w, s + i, s + more + (k - i)) + 1):
                out[f"{length}.{i}.{word[p : p + w]}"] = None
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _entry_pieces(entries: pd.Series) -> pd.Series:
    return pd.Series([entry_pieces(e) for e in entries], dtype=object)


def _word_pieces(lengths: frozenset[int]):
    return F.pandas_udf(lambda words: pd.Series([word_pieces(w, lengths) for w in words], dtype=object), T.ArrayType(T.StringType()))


def near(word: Column, entry: Column) -> Column:
    """Near in spelling: one edit from an entry of under 5 letters, two from one of under 12, else three."""
    length = F.length(entry)
    d = F.levenshtein(word, entry, 3)
    return (d >= 0) & (d <= F.when(length < 5, 1).when(length < 12, 2).otherwise(3))


def likelihood_ratio(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Dunning's ratio for a and b meeting in n_ab of n places; 0 where they meet no more often than by chance."""

    def term(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    a, b, ab, t = (c.cast("double") for c in (n_a, n_b, n_ab, n))
    ratio = 2 * (term(ab, a * b / t) + term(a - ab, a * (t - b) / t) + term(b - ab, (t - a) * b / t) + term(t - a - b + ab, (t - a) * (t - b) / t))
    return F.when(ab * t > a * b, ratio).otherwise(0.0)


@dataclass
class Matched:
    """What matching gives, folded: a building, and an address as typed, is one row, however many records have it."""

    #: site, country, num, street, kind, town, state
    sites: DataFrame
    #: s1_id, site
    members: DataFrame
    #: aid, country, num, some (has words), streets, towns, states, unknown: what each address says after all rewrites
    addresses: DataFrame
    #: s3_id, aid
    records: DataFrame
    #: aid, site
    placed: DataFrame
    #: country, slot, a, b: the rewrites as learned
    rewrites: DataFrame


SLOTS = ("street", "kind", "town", "state")


def _read(others: DataFrame, sites: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(s3_id, aid) and the different addresses with what they say in the words of the list."""
    rows = others.select("entity_id", "country", "business_address").filter("entity_id IS NOT NULL AND country IS NOT NULL").withColumn("aid", F.xxhash64("country", "business_address"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [parse_free(a) for a in pdf["business_address"]]
            yield pd.DataFrame({"aid": pdf["aid"], "country": pdf["country"], "num": [n for n, _ in parsed], "words": [w for _, w in parsed], "runs": [runs_of(w, longest) for _, w in parsed]})

    texts = spread(rows.select("aid", "country", "business_address"), "aid").dropDuplicates(["aid"])
    parsed = store(texts.mapInPandas(parse, "aid long, country string, num string, words array<string>, runs array<string>"))
    entries = F.explode(F.array(*[F.struct(F.col(s).alias("val"), F.lit(s).alias("slot")) for s in SLOTS]))
    vocabulary = sites.select("country", entries.alias("x")).select("country", "x.val", "x.slot").filter("val <> ''").groupBy("country", "val").agg(F.collect_set("slot").alias("slots"))
    said = parsed.select("aid", "country", F.explode("runs").alias("val")).join(vocabulary, ["country", "val"]).groupBy("aid").agg(F.collect_list(F.struct("val", "slots")).alias("said"))
    full = parsed.drop("runs").join(said, "aid", "left").withColumn("said", F.coalesce("said", F.expr("array()")))

    def unknown(words: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([unknown_runs(w, set(k), longest) for w, k in zip(words, known)], dtype=object)

    of = lambda slot: F.transform(F.filter("said", lambda x: F.array_contains(x["slots"], slot)), lambda x: x["val"])
    vals = F.transform("said", lambda x: x["val"])
    full = full.select("aid", "country", "num", (F.size("words") >= 1).alias("some"), (F.size("words") >= 2).alias("several"), of("street").alias("streets"), of("town").alias("towns"), of("state").alias("states"), of("kind").alias("kinds"), F.pandas_udf(unknown, T.ArrayType(T.StringType()))("words", vals).alias("unknown"), F.lit(0).alias("turn"))
    said = store(full)
    drop(parsed)
    return rows.select(F.col("entity_id").alias("s3_id"), "aid").distinct(), said


def _place(said: DataFrame, sites: DataFrame) -> DataFrame:
    """``aid, site, whole``: the building whose number, street and town an address says, or, where it says no town, the only one of
    its number and street (in a state it says, if any). Every join has one row a key on the side of the list."""
    a = said.filter("num IS NOT NULL AND size(streets) > 0")
    kind = (F.size("kinds") == 0) | (F.col("kind") == "") | F.array_contains("kinds", F.col("kind"))
    each = a.select("aid", "country", "num", "kinds", F.explode("streets").alias("street"), "towns").withColumn("town", F.explode("towns"))
    whole = each.join(sites.select("country", "num", "street", "town", "site", "kind"), ["country", "num", "street", "town"]).filter(kind).select("aid", "site").distinct()
    townless = a.filter("size(towns) = 0").select("aid", "country", "num", "kinds", "states", F.explode("streets").alias("street"))
    one = lambda *by: sites.groupBy("country", "num", "street", *by).agg(F.min("site").alias("site"), F.max("site").alias("other"), F.min("kind").alias("kind"))
    stateless = townless.filter("size(states) = 0").join(one(), ["country", "num", "street"])
    stated = townless.withColumn("state", F.explode("states")).join(one("state"), ["country", "num", "street", "state"])
    cols = ["aid", "kinds", "kind", "site", "other"]
    lone = stateless.select(cols).unionByName(stated.select(cols)).filter(kind).groupBy("aid").agg(F.min("site").alias("site"), F.max("other").alias("other")).filter("site = other")
    return whole.withColumn("whole", F.lit(True)).unionByName(lone.select("aid", "site", F.lit(False).alias("whole")))


def _contexts(towns: Column, streets: Column, states: Column) -> Column:
    """What an address may agree on besides its number, and so what is looked for: S a street in a town it says, T a town on a
    street it says, and where it says no town P a street in a state it says or N a street anywhere."""
    tag = lambda kind, vals: F.transform(vals, lambda v: F.struct(F.lit(kind).alias("ctx"), v.alias("val")))
    nothing = F.array(F.struct(F.lit("N").alias("ctx"), F.lit("").alias("val")))
    none = F.filter(nothing, lambda x: F.lit(False))
    return F.concat(tag("S", towns), tag("T", streets), F.when(F.size(towns) > 0, none).when(F.size(states) > 0, tag("P", states)).otherwise(nothing))


def _site_contexts(sites: DataFrame) -> DataFrame:
    """``ctx, country, num, val, site, slot, b``: each building under each of its contexts, with what is looked for there."""
    row = lambda ctx, val, slot: F.struct(F.lit(ctx).alias("ctx"), val.alias("val"), F.lit(slot).alias("slot"), F.col(slot).alias("b"))
    rows = F.explode(F.array(row("S", F.col("town"), "street"), row("T", F.col("street"), "town"), row("P", F.col("state"), "street"), row("N", F.lit(""), "street")))
    return sites.select("country", "num", "site", rows.alias("x")).select("x.ctx", "country", "num", "x.val", "site", "x.slot", "x.b")


def _meet(asks: DataFrame, keys: DataFrame, pieces_of: Callable[[str], Column]) -> DataFrame:
    """``q, ctx, country, a, site, slot, b, n_b, n``: what is looked for in the places of each question and is near to its words in spelling. Either
    side has a row a piece, many times what the planner takes from the size of the stored rows, so neither may be broadcast."""
    pieces = asks.drop("aid").dropDuplicates(["q"]).withColumn("piece", F.explode(pieces_of("a"))).select("q", "ctx", "country", "a", F.xxhash64("country", "num", "ctx", "val", "piece").alias("key"))
    return pieces.join(keys.hint("merge"), "key").filter(near(F.col("a"), F.col("b"))).select("q", "ctx", "country", "a", "site", "slot", "b", "n_b", "n")


def match_buildings(reference: DataFrame, others: DataFrame, mine: bool = True) -> Matched:
    """Where the addresses of ``others`` stand among the buildings of ``reference`` (both: entity_id, business_address, country).

    An address without house number or street is placed nowhere. Null ids and countries are left out; repeated rows count once.
    Every round learns at least one new pair of the finitely many near ones, so the rounds end by themselves; only addresses that a
    rewrite has changed ask again. ``mine`` False
    leaves the mining out."""
    parsed = store(reference_buildings(reference))
    building = F.xxhash64("country", "num", "street", "town").alias("site")
    sites = store(parsed.groupBy("country", "num", "street", "town").agg(F.min("kind").alias("kind"), F.min("state").alias("state")).withColumn("site", building))
    sizes = sites.agg(F.max(F.greatest(*[F.length(s) for s in SLOTS])).alias("n"), F.array_union(F.collect_set(F.length("street")), F.collect_set(F.length("town"))).alias("lengths")).first()
    longest, lengths = sizes["n"] or 0, frozenset(sizes["lengths"])  # as many lengths at most as the longest has letters
    records, said = _read(others, sites, longest)
    members = parsed.select(F.col("id").alias("s1_id"), building).distinct()
    rewrites = said.sparkSession.createDataFrame([], "country string, slot string, a string, b string")
    placed = store(_place(said, sites))
    if not mine:
        return Matched(sites, members, said, records, placed.select("aid", "site").distinct(), rewrites)

    # how many comparisons chance has: of every context, and of every entry in it, over the addresses as first read
    at = ["ctx", "country", "num", "val"]
    shelf = store(_site_contexts(sites))
    says = said.filter("num IS NOT NULL").select("country", "num", F.explode(F.concat(_contexts(F.col("towns"), F.col("streets"), F.expr("array()")), F.transform("states", lambda v: F.struct(F.lit("P").alias("ctx"), v.alias("val"))))).alias("x")).select("x.ctx", "country", "num", "x.val")
    places = store(shelf.groupBy(at).agg(F.count(F.lit(1)).alias("n_sites")).join(says.groupBy(at).agg(F.count(F.lit(1)).alias("n_addr")), at, "left").fillna(0, ["n_addr"]))
    n = places.groupBy("ctx", "country").agg(F.sum(F.col("n_sites") * F.col("n_addr")).alias("n"))
    n_b = shelf.join(places, at).groupBy("ctx", "country", "b").agg(F.sum("n_addr").alias("n_b")).join(n, ["ctx", "country"])
    keys = shelf.join(n_b, ["ctx", "country", "b"]).withColumn("piece", F.explode(_entry_pieces("b"))).select(F.xxhash64("country", "num", "ctx", "val", "piece").alias("key"), "site", "slot", "b", "n_b", "n")
    keys = store(keys)
    pieces_of = _word_pieces(lengths)
    # how often a state or a street type stands in the list
    share = lambda slot: F.count(F.lit(1)).over(Window.partitionBy("country", slot)) / F.count(F.lit(1)).over(Window.partitionBy("country"))
    common = store(sites.select("site", "country", "state", "kind", share("state").alias("state_share"), share("kind").alias("kind_share")))
    asking = answers = None
    turn = 0
    while True:
        # abbreviations, and states that the list itself writes in two ways: words against state and street type of the buildings where addresses are placed whole
        met = placed.filter("whole").join(said.select("aid", "unknown", "states"), "aid").join(common, "site")
        beside = lambda words, slot: F.transform(words, lambda w: F.struct(w.alias("a"), F.lit(slot).alias("slot"), F.col(slot).alias("b"), F.col(f"{slot}_share").alias("p")))
        met = met.select("country", F.explode(F.concat(beside(F.array_union("unknown", "states"), "state"), beside(F.col("unknown"), "kind"))).alias("x"))
        met = met.select("country", "x.*").filter("b <> ''").groupBy("country", "a", "slot", "b").agg(F.count(F.lit(1)).alias("n_ab"), F.max("p").alias("p"))
        # a word stands for what it mostly meets: of state and street type the one that is said in more of its places
        counted = met.withColumn("n_a", F.sum("n_ab").over(Window.partitionBy("country", "a", "slot"))).withColumn("best", F.max_by("slot", F.struct(F.col("n_ab") / F.col("n_a"), "slot")).over(Window.partitionBy("country", "a")))
        sure = likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("p") * 1e9, F.lit(1e9)) >= SIGNIFICANT
        # and it says so: in three places of ten and twice as often as any word, or nearly always
        said_share = F.col("n_ab") / F.col("n_a")
        often = (said_share >= 0.9) | ((said_share >= 0.3) & (said_share >= 2 * F.col("p")))
        short = store(counted.filter(sure & (F.col("slot") == F.col("best")) & often & (F.col("a") != F.col("b"))).select("country", "slot", "a", "b"))

        # spelling: unknown words of addresses without a place against streets and towns of buildings of their number; where only
        # the town is open, against towns
        waiting = said.filter((F.col("turn") == turn) & F.col("num").isNotNull() & (F.size("unknown") > 0))
        waiting = waiting.join(placed.groupBy("aid").agg(F.max("whole").alias("whole")), "aid", "left").filter("NOT coalesce(whole, false)")
        context = _contexts(F.col("towns"), F.col("streets"), F.col("states"))
        context = F.when(F.col("whole").isNull(), context).otherwise(F.filter(context, lambda x: x["ctx"] == "T"))
        asks = waiting.select("aid", "country", "num", "unknown", F.explode(context).alias("x")).select("aid", "country", "num", "x.ctx", "x.val", F.explode("unknown").alias("a"))
        asks = store(asks.join(places.drop("n_addr"), at).withColumn("q", F.xxhash64("country", "num", "ctx", "val", "a")))
        asking = asks if asking is None else asking.unionByName(asks)
        met = _meet(asks, keys, pieces_of)
        before, answers = answers, store((met if answers is None else answers.unionByName(met)).distinct())
        drop(before)
        questions = store(asking.groupBy("q", "ctx", "country", "a", "n_sites").agg(F.countDistinct("aid").alias("n_q")))
        n_ab = answers.join(questions.select("q", "n_q"), "q").groupBy("ctx", "country", "a", "slot", "b", "n_b", "n").agg(F.sum("n_q").alias("n_ab"))
        n_a = questions.groupBy("ctx", "country", "a").agg(F.sum(F.col("n_q") * F.col("n_sites")).alias("n_a"))
        spelt = n_ab.join(n_a, ["ctx", "country", "a"])
        spelt = spelt.filter(likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n")) >= SIGNIFICANT_NEAR).select("country", "slot", "a", "b")

        fresh = store(short.unionByName(spelt).distinct().join(rewrites, ["country", "slot", "a", "b"], "left_anti"))
        drop(short, questions)
        if fresh.isEmpty():
            break
        rewrites = rewrites.unionByName(fresh)
        turn += 1
        # normalise again: abbreviations in every address, spellings where the number agrees
        words = fresh.filter("slot IN ('state', 'kind')")
        more = said.select("aid", "country", F.explode(F.array_union("unknown", "states")).alias("a")).join(words, ["country", "a"]).select("aid", "slot", "a", "b")
        hit = answers.join(fresh.filter("slot IN ('street', 'town')"), ["country", "slot", "a", "b"]).select("q", "slot", "a", "b", F.levenshtein("a", "b").alias("d"))
        nearest = asking.select("aid", "q").join(hit, "q").select("aid", "slot", "a", "b", "d").distinct()
        nearest = nearest.withColumn("least", F.min("d").over(Window.partitionBy("aid", "slot"))).filter("d = least").select("aid", "slot", "a", "b")
        more = more.unionByName(nearest).groupBy("aid").agg(*[F.collect_set(F.when(F.col("slot") == s, F.col("b"))).alias(f"new_{s}") for s in SLOTS], F.collect_set("a").alias("used"))
        both = lambda old, new: F.when(F.col(new).isNull(), F.col(old)).otherwise(F.array_union(old, new)).alias(old)
        before = said, placed
        said = store(said.join(more, "aid", "left").select("aid", "country", "num", "some", "several", both("streets", "new_street"), both("towns", "new_town"), both("states", "new_state"), both("kinds", "new_kind"), F.when(F.col("used").isNull(), F.col("unknown")).otherwise(F.array_except("unknown", "used")).alias("unknown"), F.when(F.col("used").isNull(), F.col("turn")).otherwise(turn).alias("turn")))
        placed = store(_place(said, sites))
        drop(*before)
    drop(shelf, places, keys, common, answers)
    return Matched(sites, members, said, records, placed.select("aid", "site").distinct(), rewrites)


def pairs_of(found: Matched, labels: DataFrame | None = None) -> DataFrame:
    """``s1_id, s3_id`` of all records at one building, without labelled reference records: expanded from buildings only here."""
    members = found.members
    if labels is not None:
        members = members.join(labels.select(F.col("source1_entity_id").alias("s1_id")), "s1_id", "left_anti")
    return found.placed.join(members, "site").join(found.records, "aid").select("s1_id", "s3_id").distinct()


@scoped
def same_building(reference: DataFrame, others: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``s1_id, s3_id`` at one building, without the labelled reference records."""
    return pairs_of(match_buildings(reference, others), labels)


@scoped
def building_classes(reference: DataFrame, others: DataFrame) -> DataFrame:
    """``id, class_id, n_links``: one row for each record of either side that stands at a building of the list; ``class_id`` is the smallest
    reference id there and ``n_links`` the number of records of the other side at the buildings it may stand at. Linear in the records."""
    found = match_buildings(reference, others)
    theirs = found.placed.join(found.records, "aid").select("site", "s3_id").distinct()
    per = found.members.groupBy("site").agg(F.min("s1_id").alias("class_id"), F.count(F.lit(1)).alias("n1")).join(theirs.groupBy("site").agg(F.count(F.lit(1)).alias("n3")), "site", "left")
    rows = found.members.select("site", F.col("s1_id").alias("id"), F.lit(1).alias("side")).unionByName(theirs.select("site", F.col("s3_id").alias("id"), F.lit(3).alias("side"))).join(per, "site")
    return rows.groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum(F.when(F.col("side") == 1, F.coalesce("n3", F.lit(0))).otherwise(F.col("n1"))).alias("n_links"))
