"""Exact row positions inside groups of any size, and per-key results in equal-sized chunks.

Both rest on one range-partitioned sort on (keys, order): a group that holds a third of all rows simply
spans many partitions. Rows are counted per partition and key, the counts are prefix-summed over the
partitions into offsets, and every row gets ``offset + index in its run``. At most one key of a
partition began in an earlier one, so the offsets that are not zero number at most one per partition:
that is the proven bound of what goes through the driver.

Nulls: a null key is a key of its own. Ties in ``order`` get some fixed sequence of positions; give a
total order where the sequence matters. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.session import cut, shuffle_width


def range_sorted(df: DataFrame, keys: list[str], order: list[Column | str], width: int | None = None) -> DataFrame:
    """Range partitions of about equal size, sorted inside, fixed by a checkpoint."""
    n = width or shuffle_width(df.sparkSession)
    return cut(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order))


def run_offsets(fixed: DataFrame, keys: list[str]) -> dict[int, int]:
    """Partition -> rows that its first key has in earlier partitions; at most one entry a partition."""
    seen = fixed.groupBy(F.spark_partition_id().alias("_pid"), *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = seen.select("_pid", F.sum("_n").over(earlier).alias("_off")).filter("_off > 0")
    return {r["_pid"]: r["_off"] for r in offsets.collect()}


def _codes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """True where a row's key differs from the row before it (the first row: False)."""
    change = np.zeros(batch.num_rows, dtype=bool)
    for name in names:
        code = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= code[1:] != code[:-1]
    return change


def _row(batch: pa.RecordBatch, names: list[str], i: int) -> tuple:
    return tuple(batch.column(n)[i].as_py() for n in names)


def number_batches(batches: Iterator[pa.RecordBatch], keys: list[str], offset: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of one sorted partition with run starts and 1-based positions in the key's run."""
    last_key, last_pos = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = _codes(batch, keys)
        continues = last_key is not None and _row(batch, keys, 0) == last_key
        base = last_pos if continues else (offset if last_key is None else 0)
        change[0] = not continues
        starts = np.flatnonzero(change)
        at = np.arange(n, dtype=np.int64)
        begin = np.zeros(n, dtype=np.int64)
        begin[starts] = starts
        begin = np.maximum.accumulate(begin)
        pos = at - begin + 1
        first_run = n if len(starts) == 0 or (len(starts) == 1 and starts[0] == 0) else int(starts[starts > 0][0])
        pos[:first_run] = base + np.arange(1, first_run + 1)
        last_key, last_pos = _row(batch, keys, n - 1), int(pos[-1])
        yield batch, change, pos


def with_positions(df: DataFrame, keys: list[str], order: list[Column | str], position: str = "position", keep: int | None = None, width: int | None = None) -> DataFrame:
    """``df`` with the exact 1-based position of each row inside its key under ``order``; with ``keep``
    only the first ``keep`` rows of every key. A column already called ``position`` is replaced."""
    df = df.drop(position)
    fixed = range_sorted(df, keys, order, width)
    offsets = run_offsets(fixed, keys)
    schema = T.StructType([*fixed.schema.fields, T.StructField(position, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = offsets.get(TaskContext.get().partitionId(), 0)
        for batch, _, pos in number_batches(batches, keys, mine):
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos)], names=[*batch.schema.names, position])
            yield out if keep is None else out.filter(pa.array(pos <= keep))

    return fixed.mapInArrow(number, schema)


def distinct_by_key(df: DataFrame, keys: list[str], items: list[str], chunk_rows: int = 1_000_000, width: int | None = None) -> DataFrame:
    """Per key: ``n_rows`` and ``n_distinct`` items (tuples of the ``items`` columns; a null in one is a
    value like any other).

    Rows are numbered inside their key and cut into chunks of ``chunk_rows``. Each task folds the piece of a
    chunk that it holds into a state (rows, distinct items, first and last item); pieces are merged in order,
    where an item that ends one piece and begins the next counts once. No task sees more than its range
    partition, and what is shuffled after the sort is one state per key, chunk and Arrow batch.
    """
    fixed = range_sorted(df.select(*keys, *items), keys, list(items), width)
    offsets = run_offsets(fixed, keys)
    by = {f.name: f for f in fixed.schema.fields}
    schema = T.StructType(
        [T.StructField(k, by[k].dataType) for k in keys]
        + [T.StructField(n, T.LongType()) for n in ("_start", "_rows", "_distinct")]
        + [T.StructField(f"_first_{i}", by[c].dataType) for i, c in enumerate(items)]
        + [T.StructField(f"_last_{i}", by[c].dataType) for i, c in enumerate(items)]
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = offsets.get(TaskContext.get().partitionId(), 0)
        last_item: tuple | None = None
        for batch, change, pos in number_batches(batches, keys, mine):
            fresh = _codes(batch, items) | change
            fresh[0] = bool(change[0]) or _row(batch, items, 0) != last_item
            piece = change | ((pos - 1) % chunk_rows == 0)
            piece[0] = True
            starts = np.flatnonzero(piece)
            ends = np.append(starts[1:], batch.num_rows) - 1
            # a piece's own first item is always new to the piece; the merge takes off what was seen before it
            fresh[starts] = True
            rows = pa.array(ends - starts + 1)
            distinct = pa.array(np.add.reduceat(fresh.astype(np.int64), starts))
            first, last = pa.array(starts), pa.array(ends)
            last_item = _row(batch, items, batch.num_rows - 1)
            columns = [batch.column(k).take(first) for k in keys]
            columns += [pa.array(pos[starts]), rows, distinct]
            columns += [batch.column(c).take(first) for c in items] + [batch.column(c).take(last) for c in items]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    states = fixed.mapInArrow(fold, schema)
    before = Window.partitionBy(*keys).orderBy("_start")
    same = F.lit(True)
    for i, _ in enumerate(items):
        same = same & F.lag(f"_last_{i}").over(before).eqNullSafe(F.col(f"_first_{i}"))
    seen = (F.row_number().over(before) > 1) & same
    return states.withColumn("_seen", seen.cast("long")).groupBy(*keys).agg(F.sum("_rows").alias("n_rows"), (F.sum("_distinct") - F.sum("_seen")).alias("n_distinct"))
