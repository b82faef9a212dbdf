"""Splits in which bound records stay together (problem 7).

Components come from alternating large-star and small-star passes; a component's records then go, as one
item, through largest differencing into many equal bins, and whole bins are dealt to the splits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.session import cut

BINS = 64
#: Items that one task balances at once.
CHUNK_ITEMS = 4096
TARGETS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _print(edges: DataFrame) -> tuple:
    """Count and order-free fingerprint of an edge list, to see when it no longer changes."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected edges (a, b): root is the smallest node of its
    component. Loops and repeated edges don't matter; a null end binds nothing. Hot nodes: each pass folds
    with map-side partial minima, and the join back has one row a node on one side, so that a node with a
    third of all edges is split by the adaptive skew join. The number of passes grows with the logarithm of
    the longest chain squared; each ends in a checkpoint."""
    e = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # large star: every neighbour above a node goes to the least of the neighbourhood
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "k")
        big = both.filter("b > a").join(least, F.col("a") == F.col("k")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every neighbour below, and the node itself, goes to the least; edges have a > b here
        low = big.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        down = big.join(low, F.col("a") == F.col("k")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(down.union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct())
        now = _print(e)
        if now == seen:
            break
        seen = now
    roots = e.groupBy("b").agg(F.lit(1).alias("_")).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def bound_groups(pairs: DataFrame, least_p: float = 0.5) -> DataFrame:
    """``i1, group_i1`` of every S1 entity bound to another: two are bound if one ``io`` has a row with
    p >= ``least_p`` for both (null and NaN are none), and through others. Each io becomes a star to its
    smallest i1, never all its pairs."""
    strong = pairs.filter((F.col("p") >= least_p) & ~F.isnan("p") & F.col("io").isNotNull() & F.col("i1").isNotNull()).select("io", "i1")
    centre = strong.groupBy("io").agg(F.min("i1").alias("c"), F.max("i1").alias("z")).filter("c <> z").select(F.col("io").alias("k"), "c")
    star = strong.join(centre, F.col("io") == F.col("k")).select(F.col("i1").alias("a"), F.col("c").alias("b"))
    return components(star).select(F.col("node").alias("i1"), F.col("root").alias("group_i1"))


def difference(items: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest differencing of vectors of bin sums: the two with the widest spread are combined, the
    heaviest bins of one with the lightest of the other, until one is left. Returns the sums and, for every
    item, which of the final bins each of its bins became."""
    if not items:
        return np.zeros(0), []
    bins = len(items[0])
    trees: list[tuple] = []
    heap = []
    for i, v in enumerate(items):
        order = np.argsort(v, kind="stable")
        trees.append(("leaf", i, order))
        heap.append((-(v[order[-1]] - v[order[0]]), i, v[order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, s, x = heapq.heappop(heap)
        _, t, y = heapq.heappop(heap)
        z = x + y[::-1]
        order = np.argsort(z, kind="stable")
        trees.append(("node", s, t, order))
        v = z[order]
        heapq.heappush(heap, (-(v[-1] - v[0]), len(trees) - 1, v))
    _, top, sums = heap[0]
    place = [np.zeros(0, int)] * len(items)
    # walk down: final[k] is the final bin of the k-th position of a node
    todo = [(top, np.arange(bins))]
    while todo:
        at, final = todo.pop()
        tree = trees[at]
        order = tree[-1]
        back = np.empty(bins, int)
        back[order] = final
        if tree[0] == "leaf":
            place[tree[1]] = back
        else:
            todo.append((tree[1], back))
            todo.append((tree[2], back[::-1]))
    return sums, place


def assign_bins(weights: DataFrame, bins: int = BINS, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """``item, bin`` for the items of ``weights`` (item, weight). Chunks of about ``chunk_items`` items are
    balanced in tasks of their own; a chunk's bin sums are one item of the next level, until one is left. Only
    the choice of chunk needs the number of items; no item goes to the driver."""
    weights = cut(weights.select("item", F.col("weight").cast("double").alias("weight")))
    n = weights.count()
    width = max(1, -(-n // chunk_items))

    def level(vectors: DataFrame, chunks: int) -> DataFrame:
        def balance(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node", kind="stable")
            sums, place = difference([np.asarray(v, dtype=float) for v in pdf["v"]])
            return pd.DataFrame({"node": pdf["node"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "place": [p.tolist() for p in place], "v": [sums.tolist()] + [None] * (len(pdf) - 1)})

        chosen = vectors.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(chunks)), F.lit(chunks)).cast("string"))
        return cut(chosen.groupBy("chunk").applyInPandas(balance, "node string, chunk string, place array<int>, v array<double>"))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        # an item is its weight in one bin and nothing in the others: only the weight comes and only that bin goes
        pdf = pdf.sort_values("node", kind="stable")
        sums, place = difference([np.array([w, *[0.0] * (bins - 1)]) for w in pdf["weight"]])
        return pd.DataFrame({"node": pdf["node"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "bin": [int(p[0]) for p in place], "v": [sums.tolist()] + [None] * (len(pdf) - 1)})

    items = weights.select(F.col("item").cast("string").alias("node"), "weight").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(width)), F.lit(width)).cast("string"))
    placed = cut(items.groupBy("chunk").applyInPandas(first, "node string, chunk string, bin int, v array<double>"))
    bin_of = placed.select("node", "chunk", "bin")
    while width > 1:
        width = -(-width // chunk_items)
        up = level(placed.filter("v IS NOT NULL").select(F.col("chunk").alias("node"), "v"), width)
        moved = up.select(F.col("node").alias("k"), F.col("chunk").alias("next"), "place")
        bin_of = bin_of.join(moved, F.col("chunk") == F.col("k")).select("node", F.col("next").alias("chunk"), F.get("place", F.col("bin")).alias("bin"))
        placed = up
    return bin_of.join(weights.select("item", F.col("item").cast("string").alias("k")), F.col("node") == F.col("k")).select("item", "bin")


def deal(bin_weights: dict[int, float], targets: dict[str, float]) -> dict[int, str]:
    """Whole bins to splits, the heaviest first, each to the split that is furthest below its target."""
    total = sum(bin_weights.values()) or 1.0
    whole = sum(targets.values())
    got = dict.fromkeys(targets, 0.0)
    out = {}
    for b in sorted(bin_weights, key=lambda b: (-bin_weights[b], b)):
        name = max(targets, key=lambda s: (targets[s] / whole * total - got[s], s))
        got[name] += bin_weights[b]
        out[b] = name
    return out


def balanced_splits(entities: DataFrame, pairs: DataFrame, targets: dict[str, float] | None = None, bins: int = BINS) -> DataFrame:
    """``i1, group_i1, weight, bin, split`` of every S1 entity, in ``entities`` or only in pairs. Its weight is one plus its
    candidate rows; the entities of one component share a split. An id that holds no integer is left out."""
    targets = targets or TARGETS
    own = entities.select(F.regexp_extract("entity_id", r"(\d+)$", 1).try_cast("bigint").alias("i1")).filter("i1 IS NOT NULL").distinct()
    rows = pairs.filter("i1 IS NOT NULL").groupBy("i1").agg(F.count(F.lit(1)).alias("n"))
    groups = bound_groups(pairs)
    every = own.withColumn("n", F.lit(0)).unionByName(rows).groupBy("i1").agg((F.sum("n") + 1).alias("weight"))
    every = cut(every.join(groups, "i1", "left").select("i1", F.coalesce("group_i1", "i1").alias("group_i1"), "weight"))
    weights = every.groupBy("group_i1").agg(F.sum("weight").alias("weight"))
    placed = cut(assign_bins(weights.withColumnRenamed("group_i1", "item"), bins).withColumnRenamed("item", "g"))
    per_bin = placed.join(weights, F.col("g") == F.col("group_i1")).groupBy("bin").agg(F.sum("weight").alias("w"))
    split = deal({r["bin"]: float(r["w"]) for r in per_bin.collect()}, targets)  # at most `bins` rows
    named = F.create_map(*[x for b, s in sorted(split.items()) for x in (F.lit(b), F.lit(s))]) if split else F.lit(None)
    out = every.join(placed, F.col("group_i1") == F.col("g"))
    return out.select("i1", "group_i1", "weight", "bin", (F.element_at(named, F.col("bin")) if split else F.lit(None).cast("string")).alias("split"))
