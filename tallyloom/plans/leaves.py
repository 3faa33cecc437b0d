"""Every configuration of the dimensions that can occur, built variable by variable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.rules import DIMENSIONS, classified

_OUT, _IN = ("MATCHED", "ABSENT"), ("MATCHED", "PARTIAL", "ABSENT")
_MONEY = "(md_remittance IN ('PAID_FULL', 'PARTIAL', 'DUPLICATE_835') OR md_appeal = 'WON')"
# For each variable, when it is asked and what it can be. The first condition that holds counts; none: not asked.
DOMAINS: dict[str, list[tuple[str, tuple[str, ...]]]] = {
    "reimb_type": [("true", ("PHARMACY", "MEDICAL"))],
    "ph_adjudication": [("reimb_type = 'PHARMACY'", ("REJECTED", "ACCEPTED"))],
    "ph_payment": [("ph_adjudication = 'ACCEPTED'", ("NONE", "PARTIAL", "FULL", "OVER", "DUPLICATE"))],
    "ph_post_event": [
        ("ph_payment = 'NONE'", ("NONE", "REVERSAL_PRE_PAY", "ADJUSTMENT")),
        ("ph_adjudication = 'ACCEPTED'", ("NONE", "REVERSAL_POST_PAY", "RECOUPMENT", "ADJUSTMENT")),
    ],
    "ph_settlement": [("ph_payment <> 'NONE' AND ph_post_event <> 'REVERSAL_POST_PAY'", ("CONFIRMED", "MISSING"))],
    "md_clearinghouse": [("reimb_type = 'MEDICAL'", ("REJECTED", "ACCEPTED"))],
    "md_remittance": [("md_clearinghouse = 'ACCEPTED'", ("NONE", "PAID_FULL", "PARTIAL", "DENIED", "DUPLICATE_835"))],
    "md_appeal": [("md_remittance IN ('PARTIAL', 'DENIED')", ("NOT_FILED", "PENDING", "WON", "LOST"))],
    "md_post_event": [(_MONEY, ("NONE", "RECOUPMENT"))],
    "r_present": [("true", ("ABSENT", "PRESENT"))],
    "r_qualification": [("r_present = 'PRESENT'", ("PENDING", "NOT_QUALIFIED", "QUALIFIED"))],
    "r_request": [("r_qualification = 'QUALIFIED'", ("NOT_SUBMITTED", "SUBMITTED"))],
    "r_manufacturer": [("r_request = 'SUBMITTED'", ("PENDING", "APPROVED", "REJECTED"))],
    "r_payment": [("r_manufacturer = 'APPROVED'", ("NONE", "PARTIAL", "FULL", "DUPLICATE", "CLAWED_BACK"))],
    "cash_reimb_in": [(f"ph_payment <> 'NONE' OR {_MONEY}", _IN)],
    "cash_reimb_out": [("ph_post_event IN ('REVERSAL_POST_PAY', 'RECOUPMENT') OR md_post_event = 'RECOUPMENT'", _OUT)],
    "cash_rebate_in": [("r_payment <> 'NONE'", _IN)],
    "cash_rebate_out": [("r_payment = 'CLAWED_BACK'", _OUT)],
}


def _choices(name: str) -> Column:
    out = None
    for condition, values in DOMAINS[name]:
        listed = F.array(*[F.lit(v) for v in values])
        out = F.when(F.expr(condition), listed) if out is None else out.when(F.expr(condition), listed)
    return out


def leaves(spark: SparkSession) -> DataFrame:
    """One row for every configuration; a variable that is not asked is null."""
    out = spark.range(1).select()
    for name in DIMENSIONS:
        out = out.select("*", F.explode_outer(_choices(name)).alias(name))
    return out


def violations(df: DataFrame) -> DataFrame:
    """Rows of a table of configurations in which a variable has a value that its domain does not hold."""
    wrong = F.lit(False)
    for name in DIMENSIONS:
        allowed = _choices(name)
        wrong = wrong | F.when(allowed.isNull(), F.col(name).isNotNull()).otherwise(~F.coalesce(F.array_contains(allowed, F.col(name)), F.lit(False)))
    return df.where(wrong)


def verdict_pairs(spark: SparkSession) -> DataFrame:
    """``reimbursement_code, rebate_code, configurations`` of all configurations."""
    return classified(leaves(spark)).groupBy("reimbursement_code", "rebate_code").agg(F.count("*").alias("configurations"))


def depth() -> Column:
    """How many variables of a configuration were asked."""
    return sum((F.col(n).isNotNull().cast("long") for n in DIMENSIONS), F.lit(0).cast("long"))


def stratified(df: DataFrame, strata: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``turn``: rows in the order that takes one of each stratum, then a second of each, and so on."""
    from pyspark.sql import Window

    own = F.row_number().over(Window.partitionBy(*strata).orderBy(*order)).cast("long")
    return df.withColumn("turn", own)
