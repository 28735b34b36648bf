"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a worker turns into Python objects at once (a longer text goes alone).
SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode (tests), an error on a cluster."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(set_dir)
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return set_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as a table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once what was read from them is stored itself."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that are done with, ahead of the driver's own collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Lets all executors collect their heap once, which gives what they no longer need back to the system.

    Heaps only grow otherwise, beside Python workers that need the room; two
    full collections an executor of two cores take about a second.
    """
    k = spark.sparkContext.defaultParallelism
    spark.range(0, k, 1, k).where("java_method('java.lang.System', 'gc') is null").write.format("noop").mode("overwrite").save()


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before it as make it differ from every column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def remainder(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; NULL ids count as remainder of the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(of)).cast("int")


def tidy() -> None:
    """Gives memory that a worker no longer needs back to the system; idle workers stay beside the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most ``most`` bytes of ``column``, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    tidy()


def group_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by ``keys``, in tables of whole groups, with the borders of these."""

    def starts(of: pa.RecordBatch | pa.Table) -> np.ndarray:
        fresh = np.zeros(of.num_rows, dtype=bool)
        for k in keys:
            c = of.column(k).to_numpy()
            fresh[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(fresh)

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, list[int]]:
        out = pa.Table.from_batches(parts).combine_chunks()
        return out, [0, *starts(out).tolist(), out.num_rows]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield whole(held)
            held = []
        inner = starts(batch)
        if len(inner):
            yield whole([*held, batch.slice(0, int(inner[-1]))])
            held = [batch.slice(int(inner[-1]))]
        else:
            held.append(batch)
    if held:
        yield whole(held)
    held.clear()
    tidy()


def shared_rows(batches: Iterable[pa.RecordBatch], key: str, member: str) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, member) one of each pair, and these only where a key has several members.

    A batch's last row is held back until the next one's key is known, so a group of any size takes one batch of memory.
    """
    carry, before = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        k, m = batch.column(key).to_numpy(), batch.column(member).to_numpy()
        fresh = np.ones(len(k), dtype=bool)
        fresh[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        places = np.flatnonzero(fresh)
        k = k[places]
        same = np.concatenate([[before], k[1:] == k[:-1]])
        keep = same.copy()
        keep[:-1] |= same[1:]
        if len(places) > 1:
            yield batch.take(pa.array(places[:-1][keep[:-1]]))
        carry, before = batch.slice(int(places[-1]), 1), bool(same[-1])
    if carry is not None and before:
        yield carry
