"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the folder may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read on from there.

    The folder is the one in ``spark.checkpoint.dir``, which all executors
    share, so a lost executor costs no rows. Where the setting is absent, a temporary folder
    stands in if everything runs in one JVM (a local master, as in tests); on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint_"))
    return df.checkpoint()


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """The frame in partitions of about ``each`` of its counted ``rows``, if these are fewer than it has."""
    return df.coalesce(max(1, -(-rows // each))) if rows < each * shuffle_width(df.sparkSession) else df


def id_crc32(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of a document id written as decimal text (null for a null id)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(column.cast("string"), "UTF-8"))


def worker_memory() -> dict:
    """A dict that lives as long as this Python worker, which Spark uses for one task after another."""
    name = "freightlens_worker_memory"
    return vars(sys.modules.setdefault(name, ModuleType(name)))


def remembered(key: object, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once for each key while this Python worker lives."""
    memory = worker_memory()
    if key not in memory:
        memory[key] = make()
    return memory[key]
