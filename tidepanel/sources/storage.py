"""Checkpoints and cached results in the session's shared folder, and the result cache."""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir``, its lineage cut; a folder is set only where none is, in local mode (tests)."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def result_key(params: dict) -> str:
    """A hash over every parameter that changes a result."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:32]


def cached_result(spark: SparkSession, folder: str, params: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """The stored result for these parameters; computed and stored where it is missing or unreadable."""
    path = f"{folder.rstrip('/')}/{result_key(params)}.parquet"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        compute().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
