"""Where indexes and summaries of this library are kept: the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_BUILT: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or of the context's checkpoints; a temporary one if all runs in one JVM and none is set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    known = context._jsc.sc().getCheckpointDir()
    if not named and not known.isEmpty():
        named = known.get()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="freightlens_"))
    return f"{named.rstrip('/')}/freightlens-{context.applicationId}"


def built(spark: SparkSession, name: str, about: str, build: Callable[[str], object]) -> str:
    """The path of an index that ``build`` writes, once for each name and subject while the application runs."""
    key = (spark.sparkContext.applicationId, f"{name}-{hashlib.sha256(about.encode()).hexdigest()[:16]}")
    if key not in _BUILT:
        path = f"{shared_folder(spark)}/{key[1]}"
        build(path)
        _BUILT[key] = path
    return _BUILT[key]


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there; a lost executor costs none."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
