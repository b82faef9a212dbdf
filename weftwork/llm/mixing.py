"""Mixing sources to target weights (problem 9).

Two plans share one realisation. ``temperature_weights`` is temperature mixing: the natural token shares are raised to one common
exponent, bisected until the weights, with no source beyond its repetition limit, have a target entropy. One exponent can't also give every source
a share of its own, so where each has a target, ``target_weights`` fills the targets in proportion under the same limits. The weights are
realised as block permutations: each pass over a source visits its blocks in an order of its own, whole passes first, and the last
pass ends where the source's token budget does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.session import cut

BLOCK_DOCS = 4096
MIX_BLOCKS = 128


@dataclass
class Source:
    name: str
    tokens: int
    docs: int
    target: float
    repeats: int
    exponent: float = 1.0
    weight: float = 0.0


def _bisect(f, low: float, high: float, steps: int = 200) -> float:
    """The point where the falling function ``f`` crosses zero, or the nearer end."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


def entropy(weights: list[float]) -> float:
    """In nats."""
    return -sum(w * math.log(w) for w in weights if w > 0)


def held(wanted: list[float], caps: list[float]) -> list[float]:
    """Weights in proportion to ``wanted`` as far as the caps allow, of sum 1 or all that the caps give: what one source can't take goes to
    the others in proportion."""
    if not any(w > 0 for w in wanted):
        return [0.0] * len(wanted)
    reach = min(1.0, sum(c for w, c in zip(wanted, caps) if w > 0))
    top = max([c / w for w, c in zip(wanted, caps) if w > 0] + [1.0 / max(wanted)])
    factor = _bisect(lambda k: reach - sum(min(k * w, c) for w, c in zip(wanted, caps)), 0.0, top)
    return [min(factor * w, c) for w, c in zip(wanted, caps)]


def common_temperature(shares: list[float], target: float, caps: list[float] | None = None) -> tuple[float, list[float]]:
    """The exponent e and the weights share**e (normalised, held within ``caps``) whose entropy is ``target`` nats or as near as an exponent from 0
    (equal weights) to 16 comes. A source of no tokens has weight 0."""
    caps = caps or [1.0] * len(shares)

    def weights(e: float) -> list[float]:
        w = [s**e if s > 0 else 0.0 for s in shares]
        total = sum(w)
        return held([x / total for x in w], caps) if total else w

    def spread(e: float) -> float:
        w = weights(e)
        return entropy([x / (sum(w) or 1.0) for x in w])

    e = _bisect(lambda e: spread(e) - target, 0.0, 16.0)
    return e, weights(e)


def _caps(sources: list[Source], budget: float) -> list[float]:
    return [s.tokens * s.repeats / budget if budget else 0.0 for s in sources]


def temperature_weights(sources: list[Source], budget: float) -> list[Source]:
    """Sets ``exponent`` and ``weight`` by one common exponent: the mix has the entropy of the target shares of the sources that exist."""
    corpus = sum(s.tokens for s in sources) or 1
    wanted = [s.target if s.tokens else 0.0 for s in sources]
    aim = entropy([w / (sum(wanted) or 1.0) for w in wanted])
    live = [s.tokens / corpus if w > 0 else 0.0 for s, w in zip(sources, wanted)]
    e, weights = common_temperature(live, aim, _caps(sources, budget))
    for s, w, x in zip(sources, weights, live):
        s.exponent, s.weight = (e, w) if x else (math.nan, 0.0)
    return sources


def target_weights(sources: list[Source], budget: float) -> list[Source]:
    """Sets ``weight`` in proportion to the targets as far as the repetition limits allow; there is no exponent."""
    for s, w in zip(sources, held([s.target for s in sources], _caps(sources, budget))):
        s.exponent, s.weight = math.nan, w
    return sources


PLANS = {"targets": target_weights, "temperature": temperature_weights}


def source_name(col: str) -> F.Column:
    """Source names compare without case and outer blanks."""
    return F.lower(F.trim(F.col(col)))


def plan_mix(sized: DataFrame, targets: DataFrame, budget: int | None = None, by: str = "targets") -> tuple[list[Source], float]:
    """Sizes of the sources named in ``targets`` (source_name, target_share, max_repeats), and their weights. What is
    collected is one row a target; a null or repeated target name counts as none or by its largest share."""
    wanted = targets.filter("source_name IS NOT NULL").groupBy(source_name("source_name").alias("source")).agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("target"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = budget or sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    rows = wanted.join(sizes, "source", "left").collect()
    found = [Source(r["source"], r["tokens"] or 0, r["docs"] or 0, max(0.0, r["target"]), max(0, r["repeats"])) for r in sorted(rows, key=lambda r: r["source"])]
    return PLANS[by](found, float(total)), float(total)


def realise(sized: DataFrame, sources: list[Source], budget: float) -> DataFrame:
    """``doc_id, source, pass_no, n_tokens, mix_block``: one row for each copy of a document in the mix. Blocks of about
    ``BLOCK_DOCS`` documents are permuted anew in every pass; only the block in which a budget ends is looked into
    document by document. ``mix_block`` (0 to ``MIX_BLOCKS`` - 1) says where in the mix the copy stands: each holds every source in its share."""
    spark = sized.sparkSession
    plan = []
    for s in sources:
        want = s.weight * budget
        if want <= 0 or s.tokens <= 0:
            continue
        whole = min(s.repeats, int(want // s.tokens))
        rest = 0.0 if whole >= s.repeats else want - whole * s.tokens
        if rest < 1e-6 * s.tokens:  # rounding of a budget that is a whole number of passes
            rest = 0.0
        plan.append((s.name, whole, rest, float(s.tokens), want, max(1, -(-s.docs // BLOCK_DOCS))))
    schema = "of string, whole int, rest double, size double, want double, blocks int"
    small = spark.createDataFrame(plan, schema)  # one row a source of the mix
    docs = sized.join(F.broadcast(small), F.col("source") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.col("blocks")))
    passes = F.sequence(F.lit(1), F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0))
    has_pass = (F.col("whole") > 0) | (F.col("rest") > 0)
    blocks = docs.filter(has_pass).groupBy("source", "block", "whole", "rest", "size", "want").agg(F.sum("n_tokens").alias("in_block")).withColumn("pass_no", F.explode(passes))
    order = Window.partitionBy("source", "pass_no").orderBy(F.xxhash64("block", "pass_no"), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("in_block").over(order), F.lit(0)))
    last = F.col("pass_no") > F.col("whole")
    kind = F.when(~last | (F.col("before") + F.col("in_block") <= F.col("rest")), "all").when(F.col("before") < F.col("rest"), "part")
    at = F.least(((F.col("pass_no") - 1) * F.col("size") + F.col("before")) / F.col("want"), F.lit(1.0))
    chosen = blocks.withColumns({"kind": kind, "start": at, "span": F.least(F.col("in_block"), F.when(last, F.col("rest") - F.col("before")).otherwise(F.col("in_block"))) / F.col("want")}).filter("kind IS NOT NULL")
    chosen = chosen.select(F.col("source").alias("s"), F.col("block").alias("b"), "pass_no", "kind", "before", "start", "span", F.col("rest").alias("ends"))
    copies = docs.select("doc_id", "source", "n_tokens", "block").join(chosen, (F.col("source") == F.col("s")) & (F.col("block") == F.col("b")))
    inner = Window.partitionBy("source", "pass_no").orderBy(F.xxhash64("doc_id", "pass_no"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    part = copies.filter("kind = 'part'").withColumn("run", F.col("before") + F.sum("n_tokens").over(inner)).filter("run <= ends").drop("run")
    inside = F.pmod(F.xxhash64("doc_id", "pass_no", F.lit(5)), F.lit(1_000_000)) / F.lit(1e6)
    spot = F.least(F.floor((F.col("start") + inside * F.col("span")) * MIX_BLOCKS), F.lit(MIX_BLOCKS - 1)).cast("int")
    return copies.filter("kind = 'all'").unionByName(part).select("doc_id", "source", F.col("pass_no").cast("int").alias("pass_no"), "n_tokens", spot.alias("mix_block"))


def sized_documents(counted: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens`` with plain source names; fixed, as both the plan and the mix read it."""
    return cut(counted.select("doc_id", source_name("source").alias("source"), "n_tokens"))


def mix(counted: DataFrame, targets: DataFrame, budget: int | None = None, by: str = "targets") -> tuple[DataFrame, DataFrame]:
    """The mix of ``counted`` (doc_id, source, n_tokens) and the report of shares, by one of ``PLANS``.

    The budget is the corpus's size in tokens unless given. Documents of a null source or one without a target are no
    part of the mix; documents of no tokens come with the whole passes. No copy of a document beyond ``max_repeats``;
    repeated doc_ids count as documents of their own. The report has one row a target: ``source, target_share,
    max_repeats, available_tokens, exponent, planned_share, mixed_tokens, reached_share, gap`` (reached less target)."""
    sized = sized_documents(counted)
    sources, total = plan_mix(sized, targets, budget, by)
    rows = realise(sized, sources, total)
    plan = sized.sparkSession.createDataFrame(
        [(s.name, s.target, s.repeats, s.tokens, None if math.isnan(s.exponent) else round(s.exponent, 9), round(s.weight, 9)) for s in sources],
        "source string, target_share double, max_repeats int, available_tokens long, exponent double, planned_share double",
    )
    got = rows.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    report = plan.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    whole = report.agg(F.sum("mixed_tokens").alias("whole"))
    report = report.crossJoin(F.broadcast(whole)).withColumn("reached_share", F.try_divide("mixed_tokens", "whole")).drop("whole").withColumn("gap", F.coalesce("reached_share", F.lit(0.0)) - F.col("target_share"))
    return rows, report
