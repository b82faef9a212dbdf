"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark remove the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folders stored in the ``scoped`` call that is running; None outside of one.
_STORED: ContextVar[list[str] | None] = ContextVar("stored", default=None)


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "weftwork") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named on one machine, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith(("local[", "local-cluster[")) and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftwork-"))
    return sc.getCheckpointDir()


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """Queries that begin in here leave no shuffle files."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result no longer depends on its lineage and survives lost executors. The shuffles behind it are removed."""
    _ensure_checkpoint_dir(df.sparkSession)
    with _released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """As ``cut``, but in compressed columns, which take a fraction of a checkpoint's rows. Only a ``scoped`` call knows when such files are
    done with, so outside of one it is a ``cut``."""
    held, spark = _STORED.get(), df.sparkSession
    if held is None:
        return cut(df)
    path = f"{_ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    held.append(path)
    with _released(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame | None) -> None:
    """Removes what ``store`` wrote of the tables: no plan still to run may read them. Others are left alone."""
    for df in tables:
        if path := getattr(df, "__dict__", {}).get("_stored"):
            _remove(df.sparkSession, [path])


def scoped(made: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``made`` (its first argument a table) with its result checkpointed and all that it stored and shuffled on the way removed."""

    @wraps(made)
    def run(first: DataFrame, *args, **kwargs) -> DataFrame:
        held: list[str] = []
        token = _STORED.set(held)
        try:
            with _released(first.sparkSession):
                return cut(made(first, *args, **kwargs))
        finally:
            _STORED.reset(token)
            _remove(first.sparkSession, held)

    return run
