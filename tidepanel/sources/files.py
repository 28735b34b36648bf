"""File sources and sinks: typed CSV scans, conversion to Parquet, file facts, corrections, exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column types by kind of file; other columns are strings.  Unsigned types take the next wider signed one.
SCHEMAS = {
    "aggregates": {"ticker": "string", "volume": "bigint", "open": "float", "close": "float", "high": "float", "low": "float", "window_start": "bigint", "transactions": "bigint"},
    "trades": {"ticker": "string", "conditions": "string", "price": "double", "size": "bigint", "exchange": "int", "sip_timestamp": "bigint", "participant_timestamp": "bigint", "trf_timestamp": "bigint", "sequence_number": "bigint", "tape": "int", "id": "string", "correction": "int", "trf_id": "int"},
    "quotes": {"ask_price": "double", "ask_size": "bigint", "bid_price": "double", "bid_size": "bigint", "sip_timestamp": "bigint", "participant_timestamp": "bigint", "sequence_number": "bigint", "ask_exchange": "int", "bid_exchange": "int", "tape": "int"},
}
NULLS = ("", "null", "NULL", "N/A", "n/a")


def detect_kind(path: str, header: list[str]) -> str:
    """aggregates, trades or quotes, by the path or else the header."""
    for kind, words in (("trades", ("trades",)), ("quotes", ("quotes",)), ("aggregates", ("day_aggs", "minute_aggs", "aggs"))):
        if any(w in path for w in words):
            return kind
    names = {h.lower() for h in header}
    if {"bid_price", "ask_price"} & names:
        return "quotes"
    return "aggregates" if {"open", "close"} <= names else "trades"


def read_csv(spark: SparkSession, path: str, kind: str | None = None, drop_malformed: bool = True) -> DataFrame:
    """A headed CSV (gz too) with the kind's types; null tokens become NULL and rows of another width go."""
    header = spark.read.text(path).first()
    names = header[0].split(",") if header else []
    types = SCHEMAS[kind or detect_kind(path, names)]
    raw = spark.read.csv(path, header=True, mode="DROPMALFORMED" if drop_malformed else "PERMISSIVE")

    def typed(c: str):
        value = F.when(~F.col(f"`{c}`").isin(*NULLS), F.col(f"`{c}`"))
        return value.try_cast(types.get(c.lower(), "string")).alias(c)

    return raw.select(*[typed(c) for c in raw.columns])


def convert_to_parquet(spark: SparkSession, paths: list[str], out: str, kind: str | None = None, compression: str = "zstd") -> None:
    """CSV files to one Parquet folder, all in one job."""
    frames = [read_csv(spark, p, kind) for p in paths]
    joined = frames[0]
    for f in frames[1:]:
        joined = joined.unionByName(f, allowMissingColumns=True)
    joined.write.mode("overwrite").option("compression", compression).parquet(out)


def with_timestamps(bars: DataFrame) -> DataFrame:
    """``timestamps`` from ``window_start`` in nanoseconds."""
    return bars.withColumn("timestamps", F.timestamp_micros(F.expr("window_start div 1000")))


def paths_in_range(paths: list[str], start: str, end: str) -> list[str]:
    """Paths whose file name carries a date within the closed range."""
    found = [(m[1], p) for p in paths if (m := re.search(r"(\d{4}-\d{2}-\d{2})[^/]*$", p))]
    return sorted(p for d, p in found if start <= d <= end)


def latest_path(paths: list[str]) -> str:
    return max(paths, key=lambda p: p.rsplit("/", 1)[-1])


def file_facts(df: DataFrame) -> DataFrame:
    """(path, rows, bytes, changed) of the files behind a scan."""
    meta = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return meta.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.max("file_size").alias("bytes"), F.max("file_modification_time").alias("changed"))


def folder_facts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(kind, files, bytes, first, last) of the files below a folder, by extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.groupBy(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("kind")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.min("modificationTime").alias("first"), F.max("modificationTime").alias("last")
    )


def correct_overview(overview: DataFrame, remove: DataFrame, add: DataFrame, key: str = "ticker") -> DataFrame:
    """An overview without the removed keys and with added rows cast to its types."""
    cast = add.select(*[(F.col(f.name) if f.name in add.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in overview.schema])
    return overview.join(remove.select(key), key, "left_anti").unionByName(cast)


def index_rates(index: DataFrame) -> DataFrame:
    """Daily rate of an annual percentage index: close / 25200."""
    return index.select("date", (F.col("close") / F.lit(25200.0)).alias("rate"))


def export_trades(trades: DataFrame, path: str) -> None:
    """Trades as CSV: percent returns of two decimals, latest first."""
    out = trades.withColumn("ret", F.round(F.col("ret") * 100, 2)).orderBy(F.desc("buy_date"), "ticker")
    out.write.mode("overwrite").option("header", "true").csv(path)
