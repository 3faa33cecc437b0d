"""What the operators on embeddings share: which rows take part, and their entries as whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` (``v`` as doubles) of the rows whose vector is not null and holds neither nulls nor non-finite entries."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(F.col("v"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def padded(v: Column, dims: int, zero: Column) -> Column:
    """A shorter vector counts as filled up with zeros."""
    return F.concat(v, F.array_repeat(zero, F.greatest(F.lit(0), F.lit(dims) - F.size(v))))


def dimensions(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("v"))).first()[0] or 0
