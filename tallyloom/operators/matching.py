"""Joins between records that share no identifier: typed keys, bands of days, pools of what waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Why a record waits, in the order in which it is found out (fixed values).
PARK_REASONS = ("NO_KEYS_PRESENT", "NO_KEY_MATCH", "AMBIGUOUS_KEY_MATCH", "COVERED_ENTITY_MISMATCH")
ATTACHED = "ATTACHED"


def resolve(lookups: DataFrame, published: DataFrame) -> DataFrame:
    """``record_id, targets, target, decision`` of records by the targets that their keys lead to.

    ``lookups``: ``record_id, at, key_type, key_value, entity`` with one row a key, and one with a null key for a record without
    keys. ``published``: ``key_type, key_value, first_seen_at, target, target_entity``. A key counts from the moment it was first
    seen. No target parks the record, several park it as ambiguous, and one of another covered entity parks it too. No pairs of
    records and targets are made: each key's targets and look-ups are gone through once in the order of time, with how many targets were seen
    so far, the least and the largest of them, and those of their entities. Only a record that several keys lead to
    several targets has these joined, as its keys may share some.
    """
    keys = ["key_type", "key_value"]
    seen = published.where("first_seen_at IS NOT NULL AND key_type IS NOT NULL AND key_value IS NOT NULL")
    targets = seen.where("target IS NOT NULL").groupBy(*keys, "target").agg(F.min("first_seen_at").alias("at"))
    entities = seen.where("target_entity IS NOT NULL").groupBy(*keys, "target_entity").agg(F.min("first_seen_at").alias("at"))
    asked = lookups.select("record_id", "at", *keys, "entity", F.lit(True).alias("_asks"))
    moments = asked.unionByName(targets, allowMissingColumns=True).unionByName(entities, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("at"), F.asc_nulls_first("_asks")).rowsBetween(Window.unboundedPreceding, 0)
    keyed = F.col("key_type").isNotNull() & F.col("key_value").isNotNull()
    hits = moments.where(keyed).select(
        "record_id", "entity", "_asks", F.count("target").over(so_far).alias("_n"), F.min("target").over(so_far).alias("_low"), F.max("target").over(so_far).alias("_high"),
        F.min("target_entity").over(so_far).alias("_e0"), F.max("target_entity").over(so_far).alias("_e1"),
    ).where("_asks")
    none = asked.where(~keyed).select("record_id", "entity", "_asks", *[F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("_n", "_low", "_high", "_e0", "_e1")], F.col("key_value").isNotNull().alias("_has"))
    clash = contradicts(F.col("entity"), F.col("_e0")) | contradicts(F.col("entity"), F.col("_e1"))
    found = hits.withColumn("_has", F.lit(True)).unionByName(none).groupBy("record_id").agg(
        F.max("_has").alias("_keyed"), F.min("_low").alias("target"), F.max("_high").alias("_most"), F.max(clash).alias("_clash"), F.max(F.coalesce("_n", F.lit(0))).alias("targets"), F.count_if(F.col("_n") > 0).alias("_led"),
    )
    several = found.where("_led > 1 AND target <> _most").select("record_id")
    pairs = lookups.join(several, "record_id", "left_semi").select("record_id", *keys, F.col("at").alias("_now")).join(targets, keys).where(F.col("at") <= F.col("_now"))
    exact = pairs.groupBy("record_id").agg(F.count_distinct("target").alias("_exact"))
    found = found.join(exact, "record_id", "left").withColumn("targets", F.coalesce("_exact", "targets"))
    decision = (
        F.when(~F.col("_keyed"), PARK_REASONS[0]).when(F.col("target").isNull(), PARK_REASONS[1]).when(F.col("target") != F.col("_most"), PARK_REASONS[2])
        .when(F.col("_clash"), PARK_REASONS[3]).otherwise(ATTACHED)
    )
    return found.select("record_id", "targets", F.when(decision == ATTACHED, F.col("target")).alias("target"), decision.alias("decision"))


def contradicts(a: Column, b: Column) -> Column:
    """True only if both sides say something and differ."""
    return F.coalesce(a != b, F.lit(False))


def band_match(left: DataFrame, right: DataFrame, equal: list[str], left_day: str, right_day: str, left_id: str, right_id: str, days: int = 3) -> DataFrame:
    """``left_id, candidates, match``: partners with equal values and days at most ``days`` apart; ``match`` only if there is one.

    Each row of the right side is put into its bucket of ``days + 1`` days, each of the left into its own and both neighbours', so the
    join is on equal keys however many rows share the values and Spark can split it; the pairs are those of the band alone.
    """
    size = days + 1
    bucket = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / size).cast("long")
    near = left.select(*equal, F.col(left_id).alias("_l"), F.col(left_day).alias("_ld"), F.explode(F.array(*[bucket(left_day) + k for k in (-1, 0, 1)])).alias("_b"))
    far = right.select(*equal, F.col(right_id).alias("_r"), F.col(right_day).alias("_rd"), bucket(right_day).alias("_b"))
    pairs = near.join(far, [*equal, "_b"]).where(F.abs(F.date_diff("_ld", "_rd")) <= days)
    found = pairs.groupBy(F.col("_l").alias(left_id)).agg(F.count("*").alias("candidates"), F.min("_r").alias("_match"))
    return found.select(left_id, "candidates", F.when(F.col("candidates") == 1, F.col("_match")).alias("match"))


def unresolved(pool: DataFrame, resolutions: DataFrame, key: str, resolved_at: str, cursor: Column) -> DataFrame:
    """Rows of the pool without a resolution at or before the cursor."""
    return pool.join(resolutions.where(F.col(resolved_at) <= cursor).select(key), key, "left_anti")


def unclaimed(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def waiting(df: DataFrame, key: str, asked: Column, decided: Column) -> DataFrame:
    """Keys that were asked for and have no decision, in one pass over the events."""
    return df.groupBy(key).agg(F.bool_or(asked).alias("_asked"), F.bool_or(decided).alias("_decided")).where("_asked AND NOT coalesce(_decided, false)").select(key)


def unique_members(df: DataFrame, key: str, members: str, out: str) -> DataFrame:
    """``out, key`` for members that exactly one row lists; a member that several claim belongs to none."""
    flat = df.select(F.col(key), F.explode(members).alias(out)).distinct()
    return flat.groupBy(out).agg(F.count("*").alias("_n"), F.min(key).alias(key)).where("_n = 1").drop("_n")


def probable(pool: DataFrame, value: str, wanted: DataFrame, part: str, separator: str = r"\|") -> DataFrame:
    """Rows whose composite ``value`` has ``part`` as one of its components: an equi join and no scan of all pairs."""
    pieces = pool.withColumn("_piece", F.explode(F.array_distinct(F.split(value, separator))))
    return pieces.join(wanted.select(F.col(part)).distinct(), F.col("_piece") == F.col(part)).drop("_piece")


def near_ids(ids: DataFrame, column: str, wanted: int, span: int = 10, most: int = 5) -> DataFrame:
    """The ids nearest to one that does not exist: a top-k report."""
    near = ids.select(column).where(F.col(column).between(wanted - span, wanted + span)).distinct()
    return near.orderBy(F.abs(F.col(column) - wanted), column).limit(most)


def collapsed_duplicates(raw: DataFrame, normalized: DataFrame) -> DataFrame:
    """Raw rows that repeat a source's record id and have no normalised row of their own."""
    kept = raw.join(normalized.select("raw_id"), "raw_id", "left_semi").select("source_system", "source_record_id").distinct()
    return raw.join(normalized.select("raw_id"), "raw_id", "left_anti").join(kept, ["source_system", "source_record_id"], "left_semi")


def allocation_chunks(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """``df`` with ``chunk``: rows of a key in runs of ``size``."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("long"))
