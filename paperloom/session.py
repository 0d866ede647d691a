"""Session helpers: reading tables and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; only where none is named (tests), make one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="paperloom-checkpoint-"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def spread(df: DataFrame) -> DataFrame:
    """A plain scan of fewer splits than there are cores, before work that is heavy per row, on all cores; else as it is.

    Only for scans: asking for the number of partitions would run what comes before them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def evaluated(df: DataFrame, *kept: str, **columns: Column) -> DataFrame:
    """The kept columns and new ones that are computed once: a generator keeps the planner from copying their expressions into every place that uses them."""
    return df.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__once")).select(*kept, *[F.col(f"__once.{n}") for n in columns])


def present(df: DataFrame, *kept: str, **column: Column) -> DataFrame:
    """The kept columns and one new one, for rows where it isn't null; computed once, not again for the filter."""
    ((name, c),) = column.items()
    return df.select(*kept, F.explode(F.array_compact(F.array(c))).alias(name))


#: Bytes of input for a task with work that is heavy per row.
TASK_BYTES = 128 << 20


def width(df: DataFrame) -> int:
    """Partitions of a shuffle of a frame before work that is heavy per row: by the planner's estimate of its bytes, at least
    the session's number. A stated number isn't coalesced by the bytes it carries, and grows with the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # without statistics the estimate is the largest number there is
    return max(least, min(size // TASK_BYTES, 1_000_000)) if size < 1 << 60 else least
