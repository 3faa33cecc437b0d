"""What was known at a cursor, and folds over a history, one group a key and no order over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(df: DataFrame, cursor: Column, *stamps: str) -> DataFrame:
    """Rows whose stamps all lie at or before the cursor; reaches the scan as a pushed filter."""
    for stamp in stamps:
        df = df.where(F.col(stamp) <= cursor)
    return df


def latest(df: DataFrame, keys: list[str], order: list[str], cursor: Column | None = None) -> DataFrame:
    """The last row of every key by ``order`` (the first of which is the stamp), as of a cursor.

    An aggregate and no window: every task keeps one row a key before the shuffle.
    """
    rows = df if cursor is None else visible(df, cursor, order[0])
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return rows.select(*keys).distinct()
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return best.select(*keys, *[F.col("_last").getField(c).alias(c) for c in rest]).select(*df.columns)


def first_delivery(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by ``order``; a later delivery of the same key is dropped."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return best.select(*keys, *[F.col("_first").getField(c).alias(c) for c in rest]).select(*df.columns)


#: Cursors that one call may ask for.
MOST_CURSORS = 10_000


def latest_at_each(df: DataFrame, keys: list[str], order: list[str], cursors: DataFrame) -> DataFrame:
    """``cursor`` and the latest row of every key at each cursor.

    Each row is valid from its stamp until the next row of its key, and meets the cursors in between. Cursors are a few dates,
    at most ``MOST_CURSORS``, so the band join broadcasts them; no row is copied to a cursor at which it is not the answer.
    """
    if cursors.limit(MOST_CURSORS + 1).count() > MOST_CURSORS:
        raise ValueError(f"at most {MOST_CURSORS} cursors")
    by_key = Window.partitionBy(*keys).orderBy(*order)
    spans = df.withColumn("_until", F.lead(order[0]).over(by_key))
    joined = spans.join(F.broadcast(cursors), (F.col(order[0]) <= F.col("cursor")) & (F.col("_until").isNull() | (F.col("_until") > F.col("cursor"))))
    return joined.drop("_until")


def changes(df: DataFrame, keys: list[str], order: list[str], watched: list[str]) -> DataFrame:
    """Rows that differ in a watched column from the row before them, and every first row."""
    by_key = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*watched)
    return df.withColumn("_before", F.lag(now).over(by_key)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now)).drop("_before")


def carry_reopened(df: DataFrame, keys: list[str], order: list[str], state: str = "disposition", at: str = "cursor") -> DataFrame:
    """``df`` with ``reopened_from, reopened_at``: the state a case fell back from, carried on until it is CLOSED.

    A case falls back from CLOSED to anything else, or from PENDING to EXCEPTION. A later fall replaces the flag. Each fall and
    each closing opens an island of rows, and the island's first row has its value.
    """
    by_key = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(state).over(by_key)
    closed = F.col(state) == "CLOSED"
    fell = F.coalesce((~closed & (before == "CLOSED")) | ((before == "PENDING") & (F.col(state) == "EXCEPTION")), F.lit(False))
    marked = df.withColumn("_edge", F.when(fell, F.struct(before.alias("was"), F.col(at).alias("at")))).withColumn("_breaks", (F.coalesce(closed, F.lit(False)) | fell).cast("long"))
    islands = marked.withColumn("_island", F.sum("_breaks").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    value = F.first("_edge").over(Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return islands.withColumn("_flag", value).select(*df.columns, F.col("_flag.was").alias("reopened_from"), F.col("_flag.at").alias("reopened_at"))


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: str, opening: int = 0, out: str = "running_cents") -> DataFrame:
    """The balance after each row, in one account each. ``order`` must tell all rows of an account apart."""
    by_key = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.lit(opening).cast("long") + F.sum(amount).over(by_key))


def dense_ids(df: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """``df`` with numbers 1, 2, ... by ``order``, without sorting all rows in one task.

    Rows are range partitioned and stored; each partition adds its own count to those before it. The counts are one row a partition,
    so they are broadcast.
    """
    from tallyloom.sources.landing import stored

    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    return ranged.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + own).drop("_part", "_start")


def stalled(df: DataFrame, keys: list[str], order: str, score: str, least_gain: float = 1.0) -> DataFrame:
    """``df`` with ``stalled``: the last two scores are within ``least_gain`` of the best of those before them."""
    by_key = Window.partitionBy(*keys).orderBy(order)
    best = F.max(score).over(by_key.rowsBetween(Window.unboundedPreceding, -2))
    recent = F.greatest(F.col(score), F.lag(score).over(by_key))
    return df.withColumn("stalled", F.coalesce(recent - best <= least_gain, F.lit(False)))


def always_rising(df: DataFrame, keys: list[str], order: str, score: str, same: str) -> DataFrame:
    """Keys with at least two rows, each score above the one before, all with one value of ``same``."""
    by_key = Window.partitionBy(*keys).orderBy(order)
    up = df.withColumn("_up", F.coalesce(F.col(score) > F.lag(score).over(by_key), F.lit(True)))
    return up.groupBy(*keys).agg((F.bool_and("_up") & (F.count("*") > 1) & (F.count_distinct(same) == 1)).alias("rising"))
