"""Splitting amounts over lines to the exact cent, and correcting earlier splits by deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.money import floor_div

RESIDUAL = "RESIDUAL"


def largest_remainder(df: DataFrame, group: list[str], total: str, weight: str, order: list[str], out: str = "share") -> DataFrame:
    """``df`` with each row's share of its group's ``total``, in proportion to ``weight``; the shares sum to it exactly.

    Shares are floored (toward minus infinity), and the cents left over go to the largest remainders, ties by ``order``. Where
    the weights sum to zero, the first row gets all. Products are taken as decimals of 38 digits and cannot overflow.
    """
    whole = Window.partitionBy(*group)
    wide = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(19,0)")
    rows = df.withColumn("_weights", F.sum(F.coalesce(F.col(weight), F.lit(0))).over(whole).cast("decimal(19,0)"))
    product = (wide(total) * wide(weight)).cast("decimal(38,0)")
    rows = rows.withColumn("_floor", F.when(F.col("_weights") != 0, floor_div(product, F.col("_weights")).cast("long")))
    rows = rows.withColumn("_rest", F.when(F.col("_weights") != 0, F.pmod(product, F.col("_weights"))))
    rows = rows.withColumn("_left", F.col(total) - F.sum("_floor").over(whole)).withColumn("_place", F.row_number().over(whole.orderBy(F.desc_nulls_last("_rest"), *order)))
    # Without weights nothing has a remainder, so places follow the order alone.
    share = F.when(F.col("_weights") == 0, F.when(F.col("_place") == 1, F.col(total)).otherwise(0)).otherwise(F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("long"))
    return rows.withColumn(out, share.cast("long")).drop("_weights", "_floor", "_rest", "_left", "_place")


def plan(deposits: DataFrame, children: DataFrame) -> DataFrame:
    """Allocation rows of deposits over the children of the document that each deposit points at.

    ``deposits``: ``bank_id, document_id, deposit_cents, basis``. ``children``: ``document_id, child_id, kind``
    (``LINE``, ``PLB`` or ``REBATE``), ``amount_cents, episode_id``. Result: ``bank_id, document_id, child_id, episode_id,
    allocated_cents, basis``.

    A remittance's lines get what they declare where the deposit is their sum less the adjustments, for then these explain
    the gap; else deposit and adjustments are spread over the lines. Adjustments are negated. Rebate lines get what they
    declare where that is the deposit or zero, else the deposit is spread. What no episode claims, and what is left of the
    deposit, is residual, so the rows of a deposit always sum to it.
    """
    rows = deposits.join(children, "document_id")
    whole = Window.partitionBy("bank_id", "document_id")
    amount = F.coalesce(F.col("amount_cents"), F.lit(0).cast("long"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, amount).otherwise(0)).over(whole)
    rows = rows.withColumn("_lines", of("LINE")).withColumn("_plb", of("PLB")).withColumn("_rebates", of("REBATE"))
    rows = rows.withColumn(
        "_spread",
        F.when(F.col("kind") == "LINE", (F.col("_lines") - F.col("_plb") != F.col("deposit_cents")) & (F.col("_lines") > 0))
        .when(F.col("kind") == "REBATE", (F.col("_rebates") != F.col("deposit_cents")) & (F.col("_rebates") != 0))
        .otherwise(F.lit(False)),
    ).withColumn("_total", F.when(F.col("kind") == "LINE", F.col("deposit_cents") + F.col("_plb")).otherwise(F.col("deposit_cents")))
    rows = rows.withColumn("_weight", amount)
    split = largest_remainder(rows, ["bank_id", "document_id", "kind"], "_total", "_weight", ["child_id"], "_share")
    given = F.when(F.col("kind") == "PLB", -amount).when(F.col("_spread"), F.col("_share")).otherwise(amount)
    out = split.select(
        "bank_id", "document_id", "child_id", "episode_id", given.alias("allocated_cents"), F.when(F.col("episode_id").isNull(), RESIDUAL).otherwise(F.col("basis")).alias("basis")
    )
    sums = out.groupBy("bank_id", "document_id").agg(F.sum("allocated_cents").alias("_given"))
    rest = deposits.join(sums, ["bank_id", "document_id"], "left").select(
        "bank_id", "document_id", F.lit(None).cast("string").alias("child_id"), F.lit(None).cast("string").alias("episode_id"),
        (F.col("deposit_cents") - F.coalesce("_given", F.lit(0))).alias("allocated_cents"), F.lit(RESIDUAL).alias("basis"),
    )
    return out.unionByName(rest.where("allocated_cents <> 0"))


def unbalanced(deposits: DataFrame, allocations: DataFrame) -> DataFrame:
    """Deposits whose allocations do not sum to them; empty when all is well."""
    sums = allocations.groupBy("bank_id").agg(F.sum("allocated_cents").alias("allocated_cents"))
    return deposits.join(sums, "bank_id").where("allocated_cents <> deposit_cents").select("bank_id", "deposit_cents", "allocated_cents")


def deltas(current: DataFrame, desired: DataFrame, keys: list[str], amount: str = "allocated_cents") -> DataFrame:
    """Rows that, appended to ``current``, make the sums of every key those of ``desired``; null keys match null keys."""
    def summed(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum(amount).alias(out))

    signed = summed(desired, "_amount").unionByName(summed(current.withColumn(amount, -F.col(amount)), "_amount"))
    return signed.groupBy(*keys).agg(F.sum("_amount").cast("long").alias("delta_cents")).where("delta_cents <> 0")


def first_basis(allocations: DataFrame, default: str = "TRN02") -> DataFrame:
    """``bank_id, basis``: the first basis of a deposit that is not residual."""
    own = F.col("basis") != RESIDUAL
    return allocations.groupBy("bank_id").agg(F.coalesce(F.min_by(F.when(own, F.col("basis")), F.when(own, F.col("child_id"))), F.lit(default)).alias("basis"))


def identity_breaks(documents: DataFrame, children: DataFrame) -> DataFrame:
    """Documents whose declared payment is not their lines less their adjustments."""
    signed = F.when(F.col("kind") == "PLB", -F.col("amount_cents")).otherwise(F.col("amount_cents"))
    sums = children.groupBy("document_id").agg(F.sum(signed).alias("sum_cents"))
    return documents.join(sums, "document_id").where("sum_cents <> declared_cents").select("document_id", "declared_cents", "sum_cents")
