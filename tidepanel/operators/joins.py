"""As-of, range and identity joins, and row-choosing set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both tables, each once; columns are matched by name."""
    return a.unionByName(b).distinct()


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows that both tables have; columns are matched by name."""
    return a.intersect(b.select(*a.columns))


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of ``a`` that ``b`` lacks; columns are matched by name."""
    return a.subtract(b.select(*a.columns))


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, forward: bool = True) -> DataFrame:
    """Each left row with the nearest right row of its key at or after it (before it, if not ``forward``).

    Both sides are laid in one order and the payload is carried along it, so
    the cost is one sort; right rows of one key and time give the greatest payload.
    """
    payload = [c for c in right.columns if c != on]
    lefts = left.columns
    r = right.select(F.col(on).alias("_k"), F.col(right_time).alias("_t"), F.struct(*payload).alias("_p"), F.lit(0).alias("_left"))
    row = left.select(F.col(on).alias("_k"), F.col(left_time).alias("_t"), F.struct(*lefts).alias("_l"), F.lit(1).alias("_left"))
    both = r.unionByName(row, allowMissingColumns=True)
    time = F.col("_t").desc() if forward else F.col("_t").asc()
    w = Window.partitionBy("_k").orderBy(time, "_left", F.col("_p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_p", ignorenulls=True).over(w)).where("_left = 1")
    return found.select(*[F.col(f"_l.{c}").alias(c) for c in lefts], *[F.col(f"_f.{c}").alias(c) for c in payload if c not in lefts])


def range_join(points: DataFrame, intervals: DataFrame, on: str, at: str, start: str, end: str) -> DataFrame:
    """Points of a key within its closed intervals."""
    hit = (F.col(f"p.{at}") >= F.col(f"i.{start}")) & (F.col(f"p.{at}") <= F.col(f"i.{end}"))
    spare = [c for c in intervals.columns if c != on]
    return points.alias("p").join(intervals.alias("i"), (F.col(f"p.{on}") == F.col(f"i.{on}")) & hit).select("p.*", *[f"i.{c}" for c in spare])


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which a new row replaces an old one of its key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, F.col("_new")).drop("_new")


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component): the least node that each node reaches.

    Labels spread over edges and jump to the label of their label, so long
    chains take few rounds; each round is checkpointed.
    """
    from tidepanel.sources.storage import checkpointed

    both = checkpointed(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u is not null and v is not null").distinct())
    label = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    for _ in range(rounds):
        near = both.join(label.withColumnsRenamed({"u": "v", "m": "mv"}), "v").groupBy("u").agg(F.min("mv").alias("near"))
        jump = label.select(F.col("u").alias("m"), F.col("m").alias("far"))
        new = label.join(near, "u").join(jump, "m", "left").select("u", F.col("m").alias("was"), F.least("m", "near", F.coalesce("far", "m")).alias("m"))
        new = checkpointed(new)
        changed = not new.where("was <> m").isEmpty()
        label = new.select("u", "m")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return label.select(F.col("u").alias("node"), F.col("m").alias("component"))
