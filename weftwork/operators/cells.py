"""Every record that asks beside every reference record of its zone, without a row a pair on disk.

The reference is dealt into blocks and what asks into parts; a cell is one block beside one part. What a cell needs is sorted
into it, an index of the block is built in Python and the part streams past, so shuffles hold records, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.session import shuffle_width, store

#: What a row is to its cell: of all blocks, of the block, or asking.
SHARED, REFERENCE, ASKING = -1, 0, 1
#: Asking records of a part at least, so that small tables make no empty work.
LEAST = 1024
#: Rows dealt in one turn, as a multiple of those of all sides, and so many at least.
TURN, TURN_LEAST = 3, 1 << 20


def _sizes(reference: DataFrame, asking: DataFrame, block: int, part: int) -> DataFrame:
    """``zone, n, m, blocks, parts``: as many parts as keep all tasks busy, which the zones share, and more where they would be too large. What is made
    of a block is made for each part again."""
    width = shuffle_width(reference.sparkSession)
    count = lambda rows, name: rows.groupBy("zone").agg(F.count(F.lit(1)).alias(name))
    blocks = F.ceil(F.col("n") / block)
    share = F.least(F.lit(1.0), 2 * F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(0))))
    parts = F.greatest(F.ceil(F.col("m") / part), F.least(F.ceil(width * share / blocks), F.ceil(F.col("m") / LEAST)))
    return count(reference, "n").join(count(asking, "m"), "zone").select("zone", "n", "m", blocks.cast("int").alias("blocks"), parts.cast("int").alias("parts"))


def beside(
    reference: DataFrame,
    asking: DataFrame,
    build: Callable[[pa.Table], object],
    answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
    shared: DataFrame | None = None,
    block: int = 1 << 17,
    part: int = 1 << 14,
    derive: dict | None = None,
    sizes: DataFrame | None = None,
    turn: tuple[int, int] = (0, 1),
) -> DataFrame:
    """What ``answer`` makes of each batch of ``asking`` and of what ``build`` made of a block of ``reference``, for all blocks of the zone.

    All have ``zone, id`` and the same other columns; both sides are read twice. ``shared`` goes to every block of its zone, with ``side`` -1 in the
    table given to ``build``. A null zone meets none. ``derive`` are columns made from the others when rows are in their cells. ``turn`` (k, of): only
    each of-th part, from the k-th."""
    width = shuffle_width(reference.sparkSession)
    sizes = (_sizes(reference, asking, block, part) if sizes is None else sizes).select("zone", "blocks", "parts")
    own, every = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [c for c in reference.columns if c != "zone"]

    def dealt(rows: DataFrame, side: int, of_block, of_part) -> DataFrame:
        rows = rows.join(sizes, "zone").withColumn("_p", of_part("parts")).filter(F.col("_p") % turn[1] == turn[0]).withColumn("_b", of_block("blocks"))
        return rows.select(F.concat_ws(".", F.col("_b").cast("string"), F.col("_p").cast("string"), "zone").alias("cell"), F.lit(side).alias("side"), *columns)

    rows = dealt(reference, REFERENCE, own, every).unionByName(dealt(asking, ASKING, every, own))
    if shared is not None:
        rows = rows.unionByName(dealt(shared, SHARED, every, every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, side = batch.column("cell").dictionary_encode(), batch.column("side").to_numpy()
            code = cells.indices.to_numpy()
            asks = side == ASKING
            starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (asks[1:] != asks[:-1])])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                cell, rows = cells.dictionary[int(code[a])].as_py(), batch.slice(a, b - a)
                if cell != at:
                    at, held, index = cell, [], None
                if not asks[a]:
                    held.append(rows)
                elif held or index is not None:
                    if index is None:
                        index, held = build(pa.Table.from_batches(held).combine_chunks()), []
                    yield from answer(index, rows)

    rows = rows.repartition(2 * width, "cell").sortWithinPartitions("cell", "side", "id")
    return rows.withColumns(derive or {}).mapInArrow(run, schema)


def in_turns(
    reference: DataFrame,
    asking: DataFrame,
    build: Callable[[pa.Table], object],
    answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
    shared: DataFrame | None = None,
    block: int = 1 << 17,
    part: int = 1 << 14,
    derive: dict | None = None,
    then: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """``then`` of what ``beside`` gives, stored. Cells are more than in proportion to the records, so they are dealt some parts at a time, each
    time about ``TURN`` times the records, and let go before the next. ``then`` gets all answers to the records of a part at once."""
    sizes = store(_sizes(reference, asking, block, part))
    terms = 0 if shared is None else shared.count()
    dealt = F.sum(F.col("n") * F.col("parts") + F.col("m") * F.col("blocks")) + F.sum(F.col("parts") * F.col("blocks")) / F.count(F.lit(1)) * terms
    seen = sizes.agg(dealt.alias("dealt"), F.sum(F.col("n") + F.col("m")).alias("rows"), F.max("parts").alias("parts")).first()
    turns = max(1, min(seen["parts"] or 1, math.ceil((seen["dealt"] or 0) / max(TURN_LEAST, TURN * ((seen["rows"] or 0) + terms)))))
    out = None
    for k in range(turns):
        rows = store(then(beside(reference, asking, build, answer, schema, shared, block, part, derive, sizes, (k, turns))))
        out = rows if out is None else out.unionByName(rows)
    return out


def bundled(rows: DataFrame, by: list[str], term: str, parts: int) -> DataFrame:
    """``blob``, a row a part: a compressed Arrow table with a row for each combination of ``by`` and its different ``terms``, codes of a dictionary. All
    of a last ``by`` are in one part. Each of ``rows`` is shuffled once."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).group_by([*by, term]).aggregate([])
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in by])).combine_chunks()
        codes = [np.asarray(table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices) for c in by]
        first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(table)].astype(np.int32)), table.column(term).combine_chunks().dictionary_encode())
        out, sink = table.select(by).take(pa.array(first)).append_column("terms", lists), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_table(out.combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["blob"])

    return rows.select(*by, term).repartition(parts, by[-1]).mapInArrow(bundle, "blob binary")


def opened(blob: pa.Scalar) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Array]:
    """What ``bundled`` made: the table, (row, code) of every term, the dictionary."""
    table = pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks()
    row, terms = flat(table.column("terms").combine_chunks())
    return table, row, np.asarray(terms.indices), terms.dictionary


class Postings:
    """For each of ``n_terms`` terms the rows that hold it, and with what weight."""

    def __init__(self, terms: np.ndarray, owners: np.ndarray, n_terms: int, weights: np.ndarray | None = None):
        order = np.argsort(terms, kind="stable")
        self.owners = owners[order]
        self.weights = None if weights is None else weights[order]
        self.starts = np.r_[0, np.cumsum(np.bincount(terms, minlength=n_terms))].tolist()

    def add(self, scores: np.ndarray, terms: list[int], weights: list[float] | None = None) -> None:
        """Adds to ``scores`` (a row each) what every term brings; a row is in a term's list once."""
        for k, t in enumerate(terms):
            a, b = self.starts[t], self.starts[t + 1]
            scores[self.owners[a:b]] += 1 if weights is None else weights[k] * self.weights[a:b]


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of every value of the lists."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()
