"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Sizes are summed by source and hash bucket; a window over these sums finds the
bucket in which a source's budget ends; only that bucket is split again, twice.
A document is then taken when its hash lies below its source's threshold, so
nothing is sorted and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import WORD, stored, text_of

#: Bits of one level of the histogram, and of the hash.
LEVEL, LEVELS, BITS = 12, 3, 60
#: A table of one row per source is broadcast up to this many rows (about 5 MB) and shuffled beyond.
BROADCAST_SOURCES = 50_000


def doc_hash(doc_id: str) -> Column:
    """60 bits of the md5 of the id as text (NULL: of the empty text)."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def word_count(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(key, source, source_size) -> the same with ``target``.

    Sources by code point, NULL last, weigh ``weights`` in turn.  They share
    ``share`` times all sizes; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight.  Sorted by size over
    weight, the stopped sources are a prefix, so one window finds the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("w", F.get(weight, (F.row_number().over(by_name) - 1) % len(weights)))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("r", F.col("cap") / F.col("w"))
    all_rows = Window.partitionBy()
    by_level = Window.orderBy("r", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    w = w.withColumn("level", left / F.sum("w").over(after)).withColumn("k", F.row_number().over(by_level))
    first = F.min(F.when(F.col("level") <= F.col("r"), F.struct("k", "level"))).over(all_rows)
    target = F.least(F.col("cap"), F.coalesce(first["level"], F.lit(float("inf"))) * F.col("w"))
    return w.select("key", "source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """``docs`` plus size, source_size, target, taken and times (0, 1 or 2).

    ``size`` counts words (NULL and empty texts: 0).  A source whose target
    passes its size is taken whole, and its documents below the threshold once
    more.  Rows with one id share one decision (NULL ids too); ids of one
    36-bit hash prefix do as well, and the last of these groups is taken when
    that comes nearer to the target.  An empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    sized = stored(
        docs.select(key.alias("key"), F.col(source).alias("source"), word_count(text).alias("size"), doc_hash(doc_id).alias("h")),
        "mix-sizes",
    )
    sizes = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    need = F.when(F.col("target") > F.col("source_size"), F.col("target") - F.col("source_size")).otherwise(F.col("target"))
    state = stored(
        source_targets(sizes, weights, share, most).select(
            "key", "source_size", "target", (F.col("target") > F.col("source_size")).cast("int").alias("whole"),
            need.alias("need"), F.lit(0.0).alias("below"), F.lit(0).cast("bigint").alias("prefix"),
        ),
        "mix-targets",
    )
    small = state.count() <= BROADCAST_SOURCES
    held = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    rest = sized
    for level in range(1, LEVELS + 1):
        shift = BITS - LEVEL * level
        bucket = F.shiftright("h", shift)
        if level > 1:
            # only rows of a source's boundary bucket
            edge = held(state.select("key", "prefix"))
            rest = sized.join(edge, "key").where(F.shiftright("h", shift + LEVEL) == F.col("prefix")).select("key", "size", "h")
        sums = rest.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("sum"))
        upto = Window.partitionBy("key").orderBy("bucket")
        sums = sums.join(held(state), "key").withColumn("upto", F.col("below") + F.sum("sum").over(upto))
        edge = F.min(F.when(F.col("upto") >= F.col("need"), F.struct("bucket", "upto", "sum")))
        top = F.max(F.struct("bucket", "upto", "sum"))
        found = sums.groupBy("key", "source_size", "target", "whole", "need").agg(F.coalesce(edge, top).alias("e"))
        state = stored(
            found.select(
                "key", "source_size", "target", "whole", "need",
                (F.col("e.upto") - F.col("e.sum")).alias("below"), F.col("e.bucket").alias("prefix"), F.col("e.upto").alias("upto"),
            ),
            f"mix-level{level}",
        )
    near = (F.col("need") > 0) & ((F.col("upto") - F.col("need")) <= (F.col("need") - F.col("below")))
    cut = state.select("key", "source_size", "target", "whole", (F.col("prefix") + near.cast("int")).alias("cut"))
    given = ("size", "source_size", "target", "taken", "times")
    left = [c for c in docs.columns if c not in given]
    row = F.struct(*[F.col(c) for c in left]).alias("row")  # so that no column of the documents clashes with those here
    out = docs.select(row, key.alias("key"), word_count(text).alias("size"), doc_hash(doc_id).alias("h")).join(held(cut), "key")
    times = F.col("whole") + (F.shiftright("h", BITS - LEVEL * LEVELS) < F.col("cut")).cast("int")
    out = out.withColumn("times", times).withColumn("taken", F.col("times") * F.col("size"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in left], "size", "source_size", "target", "times", "taken")


#: The same by a flat sort of hash prefixes.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT >> 24 AS p
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS r FROM w),
l AS (SELECT *, row_number() OVER o AS k,
        (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
      FROM r WINDOW o AS (ORDER BY r, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(lev, k) FROM l WHERE lev <= r)) AS target FROM l),
n AS (SELECT *, CASE WHEN target > source_size THEN target - source_size ELSE target END AS need FROM t),
g AS (SELECT source, p, sum(size) AS sz FROM d GROUP BY source, p),
c AS (SELECT g.source, p, sz, sum(sz) OVER (PARTITION BY g.source ORDER BY p)::DOUBLE AS upto FROM g),
e AS (SELECT n.source, arg_min(c.p, c.p) AS p, arg_min(c.upto, c.p) AS upto, arg_min(c.sz, c.p) AS sz
      FROM n JOIN c ON c.source IS NOT DISTINCT FROM n.source AND c.upto >= n.need GROUP BY n.source),
x AS (SELECT n.*, e.p + CASE WHEN need > 0 AND upto - need <= need - (upto - sz) THEN 1 ELSE 0 END AS cut
      FROM n JOIN e ON e.source IS NOT DISTINCT FROM n.source)
SELECT d.doc_id, d.size, x.source_size, x.target,
       (d.size * ((x.target > x.source_size)::INT + (d.p < x.cut)::INT))::BIGINT AS taken
FROM d JOIN x ON x.source IS NOT DISTINCT FROM d.source
"""
