"""Aggregates over the lines of one case, as single grouped passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adjusted(adjustments: str = "adjustments") -> Column:
    """Sum of the adjustments of a line."""
    return F.aggregate(F.coalesce(F.col(adjustments), F.array()), F.lit(0).cast("long"), lambda total, a: total + F.coalesce(a["amount_cents"], F.lit(0).cast("long")))


def specific_adjustment(adjustments: str = "adjustments") -> Column:
    """Whether a line has a contractual adjustment other than the ordinary one."""
    return F.coalesce(F.exists(F.col(adjustments), lambda a: F.coalesce((a["group_code"] == "CO") & (a["reason_code"] != "45"), F.lit(False))), F.lit(False))


def one_amount(amount: str) -> Column:
    """Several lines with a single amount; a missing amount counts as one of its own. The least and the largest tell, in one pass."""
    same = (F.count(amount) == F.count("*")) & (F.min(amount) == F.max(amount))
    return (F.count("*") > 1) & (F.coalesce(same, F.lit(False)) | (F.count(amount) == 0))


def claim_line_fold(lines: DataFrame, keys: list[str], signature: str = "signature") -> DataFrame:
    """Per case: ``paid_cents, residual_cents, lines, any_final, any_forwarded, is_duplicate, any_specific``."""
    residual = F.col("charge_cents") - F.col("paid_cents") - adjusted()
    return lines.groupBy(*keys).agg(
        F.sum("paid_cents").alias("paid_cents"), F.sum(residual).alias("residual_cents"), F.count("*").alias("lines"), F.bool_or("is_final").alias("any_final"),
        F.bool_or("is_forwarded").alias("any_forwarded"), one_amount(signature).alias("is_duplicate"), F.bool_or(specific_adjustment()).alias("any_specific"),
    )


def first_leg(lines: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Values of the first line of every case in the order in which payments were issued."""
    return lines.groupBy(*keys).agg(*[F.min_by(v, F.struct(*order)).alias(n) for n, v in values.items()])


def last_status(rows: DataFrame, keys: list[str], status: str, known: tuple[str, ...], order: list[str], out: str = "status") -> DataFrame:
    """The last status by arrival among a closed set."""
    return rows.where(F.col(status).isin(*known)).groupBy(*keys).agg(F.max_by(status, F.struct(*order)).alias(out))


def signed_split(rows: DataFrame, keys: list[str], cents: Column, is_rebate: Column) -> DataFrame:
    """What came in and went out, of reimbursements and of rebates; all four are positive."""
    rebate = F.coalesce(is_rebate, F.lit(False))
    of = lambda keep, sign: F.coalesce(F.sum(F.when(keep & (cents * sign > 0), cents * sign)), F.lit(0).cast("long"))
    return rows.groupBy(*keys).agg(of(~rebate, 1).alias("reimbursement_in"), of(~rebate, -1).alias("reimbursement_out"), of(rebate, 1).alias("rebate_in"), of(rebate, -1).alias("rebate_out"))


def merged_decisions(outcomes: DataFrame, rebates: DataFrame, key: str, order: list[str], values: tuple[list[str], list[str]]) -> DataFrame:
    """The last outcome and the last rebate state of every key in one row; either side may be missing."""
    last = lambda df, cols: df.groupBy(key).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in cols])
    return last(outcomes, values[0]).join(last(rebates, values[1]), key, "full_outer")


def batches(lines: DataFrame, key: str, header: list[str], line: list[str], order: list[str]) -> DataFrame:
    """Payloads with one payment reference as one batch: the header of the first, and an entry for each."""
    return lines.groupBy(key).agg(
        *[F.min_by(h, F.struct(*order)).alias(h) for h in header], F.array_sort(F.collect_list(F.struct(*order, *line))).alias("lines"), F.count("*").alias("n_lines")
    )
