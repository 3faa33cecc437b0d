"""Control totals: what a file declares against what came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def declared(rows: DataFrame, key: str, order: str = "line_no", count_columns: tuple[str, ...] = ("record_count", "declared_record_count")) -> DataFrame:
    """``key, has_trailer, declared_count`` of every file: the last trailer's count, null where it cannot be read.

    A file without a column of record types declares nothing: its ``record_type`` is null throughout, and ``has_trailer`` too.
    """
    counts = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in count_columns if c in rows.columns], F.lit(None).cast("string"))
    number = F.when(counts.rlike("^[0-9]{1,18}$"), counts.cast("long"))
    is_trailer = F.col("record_type") == "TRAILER"
    return rows.groupBy(key).agg(
        F.bool_or(is_trailer).alias("has_trailer"), F.max_by(F.struct(number.alias("n")), F.when(is_trailer, F.col(order)))["n"].alias("declared_count"),
    )


def reconciled(observed: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """``declared_count, observed_count, agrees`` by key; a missing count is not zero and agrees with nothing but a missing one."""
    both = observed.join(declared, key, "full_outer")
    return both.select(key, "declared_count", "observed_count", F.col("declared_count").eqNullSafe(F.col("observed_count")).alias("agrees"))


def demand_agreement(totals: DataFrame) -> DataFrame:
    """The totals, which fail on being read where one does not agree: the row is recorded first, then the load stops."""
    wrong = totals.where("NOT agrees")
    if not wrong.isEmpty():
        raise ValueError(f"control totals disagree: {wrong.limit(5).toJSON().collect()}")
    return totals
