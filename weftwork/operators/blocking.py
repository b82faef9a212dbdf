"""Candidate generation as joins with an inverted index; country is part of every key, so there is no loop over countries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions.text import address_tokens, name_tokens
from weftwork.functions.wordlists import FILLER_WORDS, LEGAL_WORDS
from weftwork.operators.cells import SHARED, Postings, flat, in_turns
from weftwork.session import cut

NAME_TOKENS, ADDRESS_POSITIONS, ADDRESS_KEYS = 4, 20, 10


def _pairs_of(words: Column) -> Column:
    """Unordered pairs of different words, each as ``a_b`` with a before b."""
    each = F.transform(words, lambda a: F.transform(F.filter(words, lambda b: b > a), lambda b: F.concat(a, F.lit("_"), b)))
    return F.flatten(each)


def _neighbours(words: Column) -> Column:
    at = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.element_at(words, i), F.lit("_"), F.element_at(words, i + 1)))


def key_families(clean_name: Column, clean_address: Column) -> dict[str, Column]:
    """The six families of keys, by their prefix: words of the core name, address words, pairs of either, a name word with an address
    word, and the whole core. A name of legal and filler words only is keyed by all its words."""
    words = name_tokens(clean_name)
    core = F.filter(words, lambda w: ~w.isin(LEGAL_WORDS + FILLER_WORDS))
    core = F.when(F.size(core) > 0, core).otherwise(words)
    head = F.slice(core, 1, NAME_TOKENS)
    address = F.slice(address_tokens(clean_address), 1, ADDRESS_POSITIONS)
    picked = F.slice(F.array_distinct(F.filter(address, lambda w: (F.length(w) >= 3) | w.rlike("^[0-9]+$"))), 1, ADDRESS_KEYS)
    joined = F.array_join(core, "")
    return {
        "n": head,
        "a": picked,
        "nn": _pairs_of(head),
        "aa": _neighbours(address),
        "na": F.flatten(F.transform(head, lambda a: F.transform(picked, lambda b: F.concat(a, F.lit("@"), b)))),
        "c": F.when(F.length(joined) >= 5, F.array(joined)).otherwise(F.array().cast("array<string>")),
    }


def record_keys(records: DataFrame, id_col: str, families: tuple[str, ...] = ("n", "a", "nn", "aa", "na", "c")) -> DataFrame:
    """``<id>, country, key`` from ``nm`` and ``ad``, each key once."""
    made = key_families(F.col("nm"), F.col("ad"))

    def prefixed(family: str) -> Column:
        return F.transform(made[family], lambda k: F.concat(F.lit(f"{family}|"), k))

    keys = F.concat(*map(prefixed, families))
    return records.select(id_col, "country", F.explode(F.array_distinct(keys)).alias("key"))


def key_index(keys: DataFrame, sizes: DataFrame, df_cap: int | None) -> DataFrame:
    """``country, key, df, idf`` of the reference keys in at most ``df_cap`` records, of all without a cap; ``sizes`` is ``country, n`` of the reference."""
    df = keys.groupBy("country", "key").agg(F.count(F.lit(1)).alias("df"))
    if df_cap is not None:
        df = df.filter(F.col("df") <= df_cap)
    return df.join(sizes, "country").select("country", "key", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def within_budget(query_keys: DataFrame, id_col: str, max_keys: int, budget: int) -> DataFrame:
    """Each record's rarest keys: fewer than ``max_keys``, while those before them list under ``budget`` records; the first always."""
    w = Window.partitionBy(id_col).orderBy("df", "key")
    before = F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("df")
    ranked = query_keys.withColumns({"_rank": F.row_number().over(w) - 1, "_before": before})
    return ranked.filter((F.col("_rank") == 0) | ((F.col("_rank") < max_keys) & (F.col("_before") < budget))).drop("_rank", "_before")


def top_candidates(scored: DataFrame, top_k: int, score: str = "block_score", query: str = "io", item: str = "i1") -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc(score), F.col(item))
    return scored.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= top_k).drop("_rank")


def hot_key_candidates(query_keys: DataFrame, s1_keys: DataFrame, top_k: int, salts: int = 16) -> DataFrame:
    """The best candidates of records that have common keys only, by all of these: common keys are few, so are the different sets
    of them, and each set is scored once for all its records. ``query_keys`` is ``io, country, key, idf``; the posting lists are
    salted by their records. Most scores tie here, so they are rounded, lest the order of a sum decide."""
    sets = query_keys.groupBy("io", "country").agg(F.array_sort(F.collect_list(F.struct("key", "idf"))).alias("keys"))
    different = sets.groupBy("country", "keys").agg(F.min("io").alias("set"))
    salted = different.select("set", "country", F.explode("keys").alias("k")).select("set", "country", "k.key", "k.idf", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    postings = s1_keys.withColumn("salt", F.pmod(F.hash("i1"), F.lit(salts)))
    met = salted.join(postings, ["country", "key", "salt"])
    scored = met.groupBy("set", "i1").agg(F.round(F.sum("idf"), 9).alias("block_score"), F.count(F.lit(1)).alias("n_shared"))
    members = sets.join(different, ["country", "keys"]).select("io", "set")
    return members.join(top_candidates(scored, top_k, query="set"), "set").select("io", "i1", "block_score", "n_shared")


def posting_scores(met: DataFrame, top_k: int) -> DataFrame:
    """``io, i1, block_score, n_shared``: the ``top_k`` of each record by summed idf (ties by i1) from ``met`` (io, key, idf, list), a row a key with its
    posting list. A list stays one row through the shuffle; a record's lists are added up side by side in numpy, by key, so
    that the sums don't depend on the order in which rows came."""

    def add_up(io: np.ndarray, idf: np.ndarray, lists: pa.Array) -> pa.RecordBatch:
        sizes = np.asarray(pc.list_value_length(lists))
        i1 = np.asarray(pc.list_flatten(lists))
        at = np.repeat(np.arange(len(io)), sizes)
        order = np.lexsort((i1, io[at]))
        owner, item, weight = io[at][order], i1[order], idf[at][order]
        starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])]) if len(item) else np.zeros(0, int)
        score = np.add.reduceat(weight, starts) if len(starts) else np.zeros(0)
        count = np.diff(np.r_[starts, len(item)])
        owner, item = owner[starts], item[starts]
        order = np.lexsort((item, -score, owner))
        owner, item, score, count = owner[order], item[order], score[order], count[order]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
        top = place < top_k
        return pa.RecordBatch.from_arrays([pa.array(x[top]) for x in (owner.astype(np.int64), item.astype(np.int64), score.astype(float), count.astype(np.int64))], names=["io", "i1", "block_score", "n_shared"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            batch = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            io = batch.column("io").to_numpy()
            whole = int(np.searchsorted(io, io[-1])) if len(io) else 0  # the last record may go on in the next batch
            if whole:
                yield add_up(io[:whole], batch.column("idf").to_numpy()[:whole], batch.column("list").slice(0, whole).combine_chunks())
            rest = batch.slice(whole).combine_chunks().to_batches()
            held = rest[0] if rest else None
        if held is not None:
            yield add_up(held.column("io").to_numpy(), held.column("idf").to_numpy(), held.column("list"))

    rows = met.select("io", "key", "idf", "list").repartition("io").sortWithinPartitions("io", "key").drop("key")
    return rows.mapInArrow(score, "io long, i1 long, block_score double, n_shared long")


def key_candidates(s1_keys: DataFrame, o_keys: DataFrame, sizes: DataFrame, top_k: int = 10, df_cap: int = 1000, max_keys: int = 24, budget: int = 10_000) -> DataFrame:
    """``io, i1, block_score, n_shared``: the best ``top_k`` by the summed idf of shared keys. The cap and the budget are part
    of the operator: they leave out keys, as common words tell nothing. They leave out no record: one whose keys are all over
    the cap is scored by all of them, so every record that shares a key with the reference has candidates."""
    known = o_keys.join(key_index(s1_keys, sizes, None), ["country", "key"]).withColumn("_least", F.min("df").over(Window.partitionBy("io")))
    queries = within_budget(known.filter(F.col("df") <= df_cap), "io", max_keys, budget)
    lists = s1_keys.groupBy("country", "key").agg(F.collect_list("i1").alias("list")).filter(F.size("list") <= df_cap)
    best = posting_scores(queries.join(lists, ["country", "key"]), top_k)
    common = known.filter(F.col("_least") > df_cap).select("io", "country", "key", "idf")
    return best.unionByName(hot_key_candidates(common, s1_keys, top_k))


def generate_candidates(s1: DataFrame, others: DataFrame, top_k: int = 10, df_cap: int = 1000, max_keys: int = 24, budget: int = 10_000) -> DataFrame:
    """The candidates of records by their own keys: ``s1`` has ``i1``, ``others`` has ``io``, both ``country, nm, ad``. The keys are read
    several times, so they are made once."""
    sizes = s1.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return key_candidates(cut(record_keys(s1, "i1")), cut(record_keys(others, "io")), sizes, top_k, df_cap, max_keys, budget)


def trigrams(text: Column) -> Column:
    """Three-character runs of the text with a blank at either end, blanks inside written ``_``."""
    padded = F.concat(F.lit(" "), F.translate(text, " ", "_"), F.lit(" "))
    starts = F.when(F.length(padded) >= 3, F.sequence(F.lit(1), F.length(padded) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(padded, i, F.lit(3)))


class Vectors:
    """The texts of a table as unit vectors of the known grams: row, term and weight, by row and term. Sublinear term frequency times idf."""

    def __init__(self, grams: pa.Array, known: pa.Array, idf: np.ndarray):
        row, gram = flat(grams)
        term = pc.index_in(gram, value_set=known)
        held = np.asarray(pc.is_valid(term))
        pair, tf = np.unique(row[held] * max(1, len(known)) + np.asarray(term.filter(pa.array(held)), dtype=np.int64), return_counts=True)
        self.row, self.term = pair // max(1, len(known)), pair % max(1, len(known))
        x = (1 + np.log(tf)) * idf[self.term]
        self.starts = np.searchsorted(self.row, np.arange(len(grams) + 1))
        self.weight = x / np.sqrt(np.bincount(self.row, x * x, len(grams)))[self.row] if len(x) else x
        #: Terms of a text on average.
        self.mean = len(x) / max(1, len(grams))

    def dot(self, rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Products of the texts ``rows``, each of which has terms, with ``other`` (a weight a term)."""
        if not len(rows):
            return np.zeros(0)
        sizes = self.starts[rows + 1] - self.starts[rows]
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        at = np.arange(first[-1] + sizes[-1]) + np.repeat(self.starts[rows] - first, sizes)
        return np.add.reduceat(other[self.term[at]] * self.weight[at], first)


def tfidf_candidates(s1_texts: DataFrame, o_texts: DataFrame, top_n: int | None = 10, max_df: float | None = 0.02, min_sim: float = 0.3) -> DataFrame:
    """``io, i1, tfidf_sim``: cosine of character trigrams weighed within the country; trigrams in more than ``max_df`` of its
    reference texts are left out, none without it, and all partners stay without ``top_n``. Records meet in cells: a row a record is shuffled,
    none a gram or a pair, and a block of the reference gives its own best ``top_n``. Common trigrams weigh little: those of a text that
    can't reach ``min_sim`` by themselves find no partner, they are only added up for partners that others found, so the cosines are exact."""
    n = s1_texts.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    df = s1_texts.select("country", F.explode(F.array_distinct(trigrams(F.col("text")))).alias("gram")).groupBy("country", "gram").agg(F.count(F.lit(1)).alias("df"))
    weights = df.join(n, "country")
    if max_df is not None:
        weights = weights.filter(F.col("df") <= F.col("n") * max_df)
    weights = cut(weights.select("country", "gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    kinds = s1_texts.schema["i1"].dataType, o_texts.schema["io"].dataType
    made = lambda rows, id_col: cut(rows.filter(F.col(id_col).isNotNull()).groupBy(F.col("country").alias("zone"), F.col(id_col).alias("id")).agg(F.collect_list("text").alias("texts")))
    a, b = made(o_texts, "io"), made(s1_texts, "i1")
    # ids of either side in a column of their own, so that each keeps its type
    blank = lambda kind: F.lit(None).cast(kind)
    columns = lambda rows, i1, io, idf: rows.select("zone", "id", i1.alias("i1"), io.alias("io"), "texts", idf.cast("double").alias("idf"))
    asking = columns(a.withColumn("io", F.col("id")).withColumn("id", F.xxhash64("id")), blank(kinds[0]), F.col("io"), blank("double"))
    reference = columns(b.withColumn("i1", F.col("id")).withColumn("id", F.xxhash64("id")), F.col("i1"), blank(kinds[1]), blank("double"))
    shared = columns(weights.select(F.col("country").alias("zone"), F.xxhash64("gram").alias("id"), F.array("gram").alias("texts"), "idf"), blank(kinds[0]), blank(kinds[1]), F.col("idf"))

    def build(table: pa.Table):
        weighed = pc.equal(table.column("side"), SHARED)
        terms, rows = table.filter(weighed), table.filter(pc.invert(weighed)).combine_chunks()
        known, idf = flat(terms.column("grams").combine_chunks())[1], terms.column("idf").to_numpy()
        order = np.asarray(pc.sort_indices(known))
        known, idf = known.take(pa.array(order)), idf[order]
        ids, grams = rows.column("i1").combine_chunks(), rows.column("grams").combine_chunks()
        order = pc.sort_indices(ids)  # ties go to the smaller id
        v = Vectors(grams.take(order), known, idf)
        return known, idf, ids.take(order), v, Postings(v.term, v.row, len(known), v.weight)

    def answer(index, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, idf, ids, reference, postings = index
        v = Vectors(batch.column("grams"), known, idf)
        rarest = np.lexsort((v.term, -idf[v.term], v.row))
        terms, weights = v.term[rarest], v.weight[rarest]
        # what a term and those behind it reach at most: reference vectors are of length 1
        ahead = np.r_[0.0, np.cumsum(weights * weights)]
        reach = np.sqrt(np.maximum(0, ahead[v.starts[v.row + 1]] - ahead[:-1]))
        finds = np.r_[0, np.cumsum(reach >= min_sim - 1e-6)]
        bounds, heads = v.starts.tolist(), (v.starts[:-1] + finds[v.starts[1:]] - finds[v.starts[:-1]]).tolist()
        lists = np.diff(postings.starts)
        scores, own = np.zeros(len(ids)), np.zeros(len(known))
        asked, items, sims, n = [], [], [], 0
        for i, (x, y, z) in enumerate(zip(bounds, heads, bounds[1:])):
            if x < z:
                postings.add(scores, terms[x:y].tolist(), weights[x:y].tolist())
                hits = np.flatnonzero(scores)
                if y < z and len(hits):
                    hits = hits[scores[hits] >= min_sim - reach[y] - 1e-6]
                if y < z and reference.mean * len(hits) < lists[terms[y:z]].sum():
                    own[terms[x:z]] = weights[x:z]
                    found = reference.dot(hits, own)
                    own[terms[x:z]] = 0
                else:
                    postings.add(scores, terms[y:z].tolist(), weights[y:z].tolist())
                    found = scores[hits]
                scores.fill(0)
                found = np.round(found, 12)  # sums of one value in another order tie
                kept = found >= min_sim
                hits, found = hits[kept], found[kept]
                if top_n is not None and len(hits):
                    best = np.lexsort((hits, -found))[:top_n]
                    hits, found = hits[best], found[best]
                asked.append(np.full(len(hits), i))
                items.append(hits)
                sims.append(found)
                n += len(hits)
            if n and (n >= 1 << 18 or i + 1 == batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column("io").take(pa.array(np.concatenate(asked))), ids.take(pa.array(np.concatenate(items))), pa.array(np.concatenate(sims))], names=["io", "i1", "tfidf_sim"])
                asked, items, sims, n = [], [], [], 0

    grams = F.when(F.col("side") == SHARED, F.col("texts")).otherwise(F.flatten(F.transform("texts", trigrams)))
    schema = T.StructType([T.StructField("io", kinds[1]), T.StructField("i1", kinds[0]), T.StructField("tfidf_sim", T.DoubleType())])
    return in_turns(reference, asking, build, answer, schema, shared, block=1 << 16, part=1 << 16, derive={"grams": grams}, then=lambda sims: sims if top_n is None else top_candidates(sims, top_n, "tfidf_sim"))


def merge_passes(by_key: DataFrame, by_text: DataFrame) -> DataFrame:
    """Both passes, a score that a pass did not give is 0."""
    both = by_key.join(by_text, ["io", "i1"], "full")
    return both.select("io", "i1", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("block_score", "n_shared", "tfidf_sim")])


def reference_context(candidates: DataFrame, keep_k: int = 0) -> DataFrame:
    """``n_cand_1`` and ``rank_block_1``: how crowded a reference record is, over the candidates as they came in."""
    if keep_k:
        candidates = top_candidates(candidates, keep_k)
    w = Window.partitionBy("i1")
    return candidates.withColumns({"n_cand_1": F.count(F.lit(1)).over(w), "rank_block_1": F.row_number().over(w.orderBy(F.desc("block_score"), "io"))})


def anchors(candidates: DataFrame) -> DataFrame:
    """``io, parent``: the top candidate of every record."""
    return top_candidates(candidates, 1).select("io", F.col("i1").alias("parent"))
