"""Ordered rules: dimensions to verdicts, flags and a disposition, as one CASE chain each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The dimensions in the order in which they are decided (fixed values).
DIMENSIONS = (
    "reimb_type", "ph_adjudication", "ph_payment", "ph_post_event", "ph_settlement", "md_clearinghouse", "md_remittance", "md_appeal", "md_post_event",
    "r_present", "r_qualification", "r_request", "r_manufacturer", "r_payment", "cash_reimb_in", "cash_reimb_out", "cash_rebate_in", "cash_rebate_out",
)

# The rules of each track, in the order in which they hold. The first that fits decides.
PHARMACY_RULES: list[tuple[dict[str, str], str]] = [
    ({"ph_adjudication": "REJECTED"}, "A-01"),
    ({"ph_post_event": "REVERSAL_PRE_PAY"}, "A-16"),
    ({"ph_post_event": "REVERSAL_POST_PAY", "cash_reimb_out": "MATCHED"}, "A-10"),
    ({"ph_post_event": "REVERSAL_POST_PAY"}, "A-11"),
    ({"ph_post_event": "RECOUPMENT", "cash_reimb_out": "MATCHED"}, "A-12"),
    ({"ph_post_event": "RECOUPMENT"}, "A-13"),
    ({"ph_payment": "NONE"}, "A-02"),
    ({"ph_payment": "DUPLICATE"}, "A-17"),
    ({"ph_payment": "OVER"}, "A-09"),
    ({"ph_payment": "PARTIAL", "ph_post_event": "ADJUSTMENT", "cash_reimb_in": "MATCHED"}, "A-14"),
    ({"ph_payment": "PARTIAL", "ph_post_event": "ADJUSTMENT"}, "A-15"),
    ({"ph_payment": "PARTIAL", "cash_reimb_in": "ABSENT"}, "A-08"),
    ({"ph_payment": "PARTIAL"}, "A-07"),
    ({"ph_payment": "FULL", "ph_post_event": "ADJUSTMENT", "cash_reimb_in": "MATCHED"}, "A-14"),
    ({"ph_payment": "FULL", "ph_post_event": "ADJUSTMENT"}, "A-15"),
    ({"ph_payment": "FULL", "cash_reimb_in": "ABSENT"}, "A-05"),
    ({"ph_payment": "FULL", "cash_reimb_in": "PARTIAL"}, "A-07"),
    ({"ph_payment": "FULL", "ph_settlement": "MISSING"}, "A-06"),
    ({"ph_payment": "FULL"}, "A-04"),
]
MEDICAL_RULES: list[tuple[dict[str, str], str]] = [
    ({"md_clearinghouse": "REJECTED"}, "B-01"),
    ({"md_post_event": "RECOUPMENT"}, "B-15"),
    ({"md_remittance": "NONE"}, "B-02"),
    ({"md_remittance": "DUPLICATE_835"}, "B-16"),
    ({"md_remittance": "PAID_FULL", "cash_reimb_in": "ABSENT"}, "B-05"),
    ({"md_remittance": "PAID_FULL", "cash_reimb_in": "PARTIAL"}, "B-06"),
    ({"md_remittance": "PAID_FULL"}, "B-04"),
    ({"md_remittance": "PARTIAL", "md_appeal": "NOT_FILED"}, "B-06"),
    ({"md_remittance": "PARTIAL", "md_appeal": "PENDING"}, "B-07"),
    ({"md_remittance": "PARTIAL", "md_appeal": "WON", "cash_reimb_in": "ABSENT"}, "B-14"),
    ({"md_remittance": "PARTIAL", "md_appeal": "WON"}, "B-08"),
    ({"md_remittance": "PARTIAL", "md_appeal": "LOST"}, "B-09"),
    ({"md_remittance": "DENIED", "md_appeal": "NOT_FILED"}, "B-10"),
    ({"md_remittance": "DENIED", "md_appeal": "PENDING"}, "B-11"),
    ({"md_remittance": "DENIED", "md_appeal": "WON", "cash_reimb_in": "ABSENT"}, "B-14"),
    ({"md_remittance": "DENIED", "md_appeal": "WON"}, "B-12"),
    ({"md_remittance": "DENIED", "md_appeal": "LOST"}, "B-13"),
]
REBATE_RULES: list[tuple[dict[str, str], str]] = [
    ({"r_present": "ABSENT"}, "C-00"),
    ({"r_qualification": "PENDING"}, "C-01"),
    ({"r_qualification": "NOT_QUALIFIED"}, "C-02"),
    ({"r_request": "NOT_SUBMITTED"}, "C-03"),
    ({"r_manufacturer": "PENDING"}, "C-05"),
    ({"r_manufacturer": "REJECTED"}, "C-07"),
    ({"r_payment": "NONE"}, "C-11"),
    ({"r_payment": "CLAWED_BACK"}, "C-13"),
    ({"r_payment": "DUPLICATE"}, "C-14"),
    ({"r_payment": "PARTIAL"}, "C-10"),
    ({"r_payment": "FULL", "cash_rebate_in": "ABSENT"}, "C-09"),
    ({"r_payment": "FULL", "cash_rebate_in": "PARTIAL"}, "C-10"),
    ({"r_payment": "FULL"}, "C-08"),
]
# What each code means for the case, and why.
DISPOSITIONS: dict[str, tuple[str | None, tuple[str, ...]]] = {
    "A-01": ("CLOSED", ("REJECTED_AT_POS",)),
    "A-02": ("PENDING", ("AWAITING_REMITTANCE",)),
    "A-04": ("CLOSED", ()),
    "A-05": ("EXCEPTION", ("NO_CASH",)),
    "A-06": ("EXCEPTION", ("SETTLEMENT_MISSING",)),
    "A-07": ("EXCEPTION", ("UNDERPAID",)),
    "A-08": ("EXCEPTION", ("UNDERPAID", "NO_CASH")),
    "A-09": ("EXCEPTION", ("OVERPAID",)),
    "A-10": ("CLOSED", ()),
    "A-11": ("EXCEPTION", ("REVERSAL_CASH_NOT_RETURNED",)),
    "A-12": ("CLOSED", ()),
    "A-13": ("EXCEPTION", ("RECOUPMENT_UNTRACEABLE", "INSUFFICIENT_DATA")),
    "A-14": ("CLOSED", ()),
    "A-15": ("EXCEPTION", ("ADJUSTMENT_RESIDUAL",)),
    "A-16": ("CLOSED", ()),
    "A-17": ("EXCEPTION", ("DUPLICATE_PAYMENT",)),
    "B-01": ("EXCEPTION", ("CLEARINGHOUSE_REJECTED",)),
    "B-02": ("PENDING", ("AWAITING_REMITTANCE",)),
    "B-04": ("CLOSED", ()),
    "B-05": ("EXCEPTION", ("NO_CASH",)),
    "B-06": ("EXCEPTION", ("UNDERPAID",)),
    "B-07": ("PENDING", ("APPEAL_PENDING",)),
    "B-08": ("CLOSED", ()),
    "B-09": ("EXCEPTION", ("APPEAL_LOST",)),
    "B-10": ("EXCEPTION", ("DENIED",)),
    "B-11": ("PENDING", ("APPEAL_PENDING",)),
    "B-12": ("CLOSED", ()),
    "B-13": ("EXCEPTION", ("APPEAL_LOST", "DENIED")),
    "B-14": ("EXCEPTION", ("APPEAL_WON_NO_CASH",)),
    "B-15": ("EXCEPTION", ("CASH_MISMATCH",)),
    "B-16": ("EXCEPTION", ("DUPLICATE_REMITTANCE",)),
    "C-00": (None, ()),
    "C-01": ("PENDING", ("REBATE_AWAITING_QUALIFICATION",)),
    "C-02": ("CLOSED", ("REBATE_NOT_QUALIFIED",)),
    "C-03": ("PENDING", ("REBATE_AWAITING_SUBMISSION",)),
    "C-05": ("PENDING", ("REBATE_AWAITING_MANUFACTURER",)),
    "C-07": ("CLOSED", ("REBATE_REJECTED",)),
    "C-08": ("CLOSED", ()),
    "C-09": ("EXCEPTION", ("REBATE_NO_CASH",)),
    "C-10": ("EXCEPTION", ("REBATE_UNDERPAID",)),
    "C-11": ("PENDING", ("REBATE_AWAITING_PAYMENT",)),
    "C-13": ("EXCEPTION", ("REBATE_CLAWED_BACK",)),
    "C-14": ("EXCEPTION", ("DUPLICATE_REBATE",)),
}
# Reasons that a flag adds, and whether it makes an exception.
FLAG_EFFECTS: dict[str, tuple[tuple[str, ...], bool]] = {
    "X-1": (("DENIED_WITH_REBATE_PAID",), True),
    "X-2": (("REBATE_ON_UNDISPENSED_CLAIM",), True),
    "X-3": (("QUALIFICATION_UNDERMINED_BY_RECOUPMENT",), True),
    "X-4": ((), False),
    "X-5": (("CORRELATED_CASH_GAP", "INSUFFICIENT_DATA"), True),
    "X-6": (("TOTAL_LOSS",), True),
    "X-7": (("REBATE_RE_REQUEST_AVAILABLE",), True),
}
RANK = {"CLOSED": 0, "PENDING": 1, "EXCEPTION": 2}
#: Verdicts at which nothing more is expected (fixed values).
NOTHING_EXPECTED = ("A-01", "A-10", "A-11", "A-16")
NO_REBATE_EXPECTED = ("C-00", "C-02", "C-07")


def _is(column: str, *values: str) -> Column:
    """True or false, never null."""
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def _chain(rules: list[tuple[dict[str, str], str]], track: str) -> Column:
    out = None
    for needs, code in rules:
        fits = reduce(lambda a, b: a & b, [_is(c, v) for c, v in needs.items()])
        out = F.when(fits, code) if out is None else out.when(fits, code)
    return out.otherwise(F.raise_error(F.lit(f"no {track} rule fits")))


def reimbursement_code() -> Column:
    return F.when(_is("reimb_type", "PHARMACY"), _chain(PHARMACY_RULES, "pharmacy")).otherwise(_chain(MEDICAL_RULES, "medical"))


def rebate_code() -> Column:
    return _chain(REBATE_RULES, "rebate")


def not_dispensed() -> Column:
    return _is("reimb_type", "PHARMACY") & (_is("ph_adjudication", "REJECTED") | _is("ph_post_event", "REVERSAL_PRE_PAY", "REVERSAL_POST_PAY"))


def reimbursement_failed() -> Column:
    medical = (_is("md_remittance", "DENIED") & _is("md_appeal", "NOT_FILED", "LOST")) | _is("md_clearinghouse", "REJECTED")
    return F.when(_is("reimb_type", "PHARMACY"), _is("ph_adjudication", "REJECTED")).otherwise(medical)


def reimbursement_settled() -> Column:
    cash = _is("cash_reimb_in", "MATCHED")
    pharmacy = _is("ph_settlement", "CONFIRMED") & _is("ph_post_event", "NONE", "ADJUSTMENT")
    return cash & F.when(_is("reimb_type", "PHARMACY"), pharmacy).otherwise(_is("md_remittance", "PAID_FULL") & _is("md_post_event", "NONE"))


def flags() -> Column:
    """The flags that hold, in order; each is judged by itself."""
    tests = {
        "X-1": reimbursement_failed() & _is("r_payment", "PARTIAL", "FULL", "DUPLICATE"),
        "X-2": not_dispensed() & _is("r_manufacturer", "APPROVED") & ~_is("r_payment", "CLAWED_BACK"),
        "X-3": _is("ph_post_event", "RECOUPMENT") & _is("r_qualification", "QUALIFIED"),
        "X-4": reimbursement_settled() & _is("r_manufacturer", "REJECTED"),
        "X-5": _is("cash_reimb_in", "ABSENT") & _is("cash_rebate_in", "ABSENT"),
        "X-6": reimbursement_failed() & (_is("r_manufacturer", "REJECTED") | _is("r_qualification", "NOT_QUALIFIED")),
        "X-7": _is("md_appeal", "WON") & _is("r_payment", "CLAWED_BACK"),
    }
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda f: f.isNotNull())


def coherence() -> Column:
    live = not_dispensed() & ~_is("r_present", "ABSENT") & ~_is("r_qualification", "NOT_QUALIFIED") & ~_is("r_payment", "CLAWED_BACK")
    return F.when(live, "ANOMALY").otherwise("COHERENT")


def _lookup(pairs: dict, code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), code)


def _reasons(code: Column) -> Column:
    table = F.create_map(*[x for k, (_, why) in DISPOSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in why]).cast("array<string>"))])
    return F.element_at(table, code)


def disposition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, d, list(w)) for k, (d, w) in DISPOSITIONS.items()], "code string, disposition string, reasons array<string>")


def classified(df: DataFrame) -> DataFrame:
    """``df`` with ``reimbursement_code, rebate_code, flags, coherence``; needs the columns of ``DIMENSIONS``."""
    return df.select("*", reimbursement_code().alias("reimbursement_code"), rebate_code().alias("rebate_code"), flags().alias("flags"), coherence().alias("coherence"))


def composed(df: DataFrame, priced: Column | None = None) -> DataFrame:
    """``df`` with ``disposition`` and ``reasons`` of a classified table.

    The worse of both tracks' dispositions, or EXCEPTION if a flag says so. Reasons of the reimbursement, the rebate and the flags follow each
    other; INSUFFICIENT_DATA comes last, once, for a claim that could not be ``priced``.
    """
    ranks = {k: RANK[d] for k, (d, _) in DISPOSITIONS.items() if d}
    forced = F.exists("flags", lambda f: f.isin([k for k, (_, x) in FLAG_EFFECTS.items() if x]))
    worst = F.greatest(_lookup(ranks, F.col("reimbursement_code")), _lookup(ranks, F.col("rebate_code")), F.when(forced, RANK["EXCEPTION"]))
    names = F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (v, k)])
    by_flag = F.create_map(*[x for k, (why, _) in FLAG_EFFECTS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in why]).cast("array<string>"))])
    reasons = F.concat(_reasons(F.col("reimbursement_code")), _reasons(F.col("rebate_code")), F.flatten(F.transform("flags", lambda f: F.element_at(by_flag, f))))
    if priced is not None:
        short = ~F.coalesce(priced, F.lit(False)) & ~_is("reimbursement_code", "A-01", "B-01") & ~F.array_contains(reasons, "INSUFFICIENT_DATA")
        reasons = F.when(short, F.concat(reasons, F.array(F.lit("INSUFFICIENT_DATA")))).otherwise(reasons)
    return df.select("*", F.element_at(names, worst).alias("disposition"), reasons.alias("reasons"))


def still_expected(expected: Column, rebate: Column) -> tuple[Column, Column]:
    """Expected amounts, zero where the verdict leaves nothing to expect."""
    zero = F.lit(0).cast("long")
    return F.when(_is("reimbursement_code", *NOTHING_EXPECTED), zero).otherwise(expected), F.when(_is("rebate_code", *NO_REBATE_EXPECTED), zero).otherwise(rebate)
