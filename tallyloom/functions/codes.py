"""What wire codes mean, as literal maps: no join, and null for a code that the vocabulary lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reject codes of each vocabulary and the one set of meanings that they share.
REJECTS: dict[str, dict[str, str]] = {
    "NCPDP_NUMERIC": {
        "70": "NOT_COVERED", "75": "PRIOR_AUTH_REQUIRED", "76": "PLAN_LIMIT_EXCEEDED", "79": "REFILL_TOO_SOON", "88": "DUR_REJECT",
        "40": "PHARMACY_NOT_CONTRACTED", "65": "PATIENT_NOT_COVERED", "21": "INVALID_PRODUCT", "25": "INVALID_PRESCRIBER",
    },
    "CASCADE_ALPHA": {
        "A1": "NOT_COVERED", "A4": "PRIOR_AUTH_REQUIRED", "A7": "PLAN_LIMIT_EXCEEDED", "B2": "REFILL_TOO_SOON", "B9": "DUR_REJECT",
        "C3": "PHARMACY_NOT_CONTRACTED", "C8": "PATIENT_NOT_COVERED", "D1": "INVALID_PRODUCT", "D6": "INVALID_PRESCRIBER",
    },
}
# Adjustments by group and reason.
ADJUSTMENTS: dict[str, str] = {
    "CO-45": "CONTRACTUAL_ADJUSTMENT", "CO-97": "BUNDLED", "CO-16": "MISSING_INFORMATION", "CO-18": "DUPLICATE", "CO-50": "NOT_MEDICALLY_NECESSARY",
    "CO-151": "FREQUENCY_EXCEEDED", "CO-197": "PRIOR_AUTH_ABSENT", "PR-1": "DEDUCTIBLE", "PR-2": "COINSURANCE", "PR-3": "COPAY", "PR-204": "NOT_COVERED",
}
# Provider level adjustments, whether they lessen (1) or raise (-1) a deposit, and whether they name a claim.
PROVIDER_LEVEL: dict[str, tuple[int, bool]] = {"WO": (1, True), "FB": (1, False), "L6": (-1, False), "CS": (1, True), "72": (1, True), "RA": (-1, True)}
# Claim states of a remittance line.
CLAIM_STATES: dict[str, str] = {"1": "PAID_PRIMARY", "19": "FORWARDED", "25": "PREDETERMINATION", "4": "DENIED", "22": "REVERSAL"}
# What a record of each kind is evidence of; a kind that is not here counts as adjudication.
EVIDENCE_ROLES: dict[str, str] = {
    "PHARMACY_CLAIM": "ADJUDICATION", "PHARMACY_REVERSAL": "REVERSAL", "REMITTANCE_CLAIM_LINE": "REMITTANCE_CLAIM_LINE",
    "PROVIDER_LEVEL_ADJUSTMENT": "PROVIDER_LEVEL_ADJUSTMENT", "MEDICAL_SUBMISSION": "MEDICAL_SUBMISSION", "MEDICAL_ACKNOWLEDGMENT": "MEDICAL_SUBMISSION",
    "TPA_QUALIFICATION": "TPA_QUALIFICATION", "TPA_REBATE_REQUEST": "TPA_QUALIFICATION", "TPA_MANUFACTURER_DECISION": "TPA_QUALIFICATION",
    "TPA_REVERSAL": "REVERSAL", "REBATE_DISPENSE_LINE": "REBATE_LINE", "BANK_TRANSACTION": "BANK_CREDIT", "BEACON_ACKNOWLEDGMENT": "REBATE_SUBMISSION",
    "BEACON_VALIDATION_OUTCOME": "REBATE_SUBMISSION", "BEACON_PAYMENT_REFERENCE": "REBATE_SUBMISSION", "TPA_INVOICE_LINE": "TPA_INVOICE",
}


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def reject_meaning(vocabulary: Column, code: Column) -> Column:
    """The meaning of a reject code in the vocabulary of its payer; null for one that this does not use."""
    flat = {f"{v} {c}": m for v, codes in REJECTS.items() for c, m in codes.items()}
    return _looked_up(flat, F.concat_ws(" ", vocabulary, code))


def adjustment_meaning(group: Column, reason: Column) -> Column:
    return _looked_up(ADJUSTMENTS, F.concat_ws("-", group, reason))


def provider_level_sign(code: Column) -> Column:
    return _looked_up({c: s for c, (s, _) in PROVIDER_LEVEL.items()}, code)


def provider_level_traceable(code: Column) -> Column:
    return _looked_up({c: t for c, (_, t) in PROVIDER_LEVEL.items()}, code)


def claim_state(code: Column) -> Column:
    return _looked_up(CLAIM_STATES, code)


def evidence_role(kind: Column) -> Column:
    return F.coalesce(_looked_up(EVIDENCE_ROLES, kind), F.lit("ADJUDICATION"))


def whole_units(quantity_milli: Column) -> Column:
    """Thousandths as whole units for display; none for null."""
    return F.floor(F.coalesce(quantity_milli, F.lit(0)) / 1000).cast("long")


#: How far a deposit's basis proves where the money belongs (fixed values).
MATCH_STRENGTH: dict[str, str] = {
    "TRN02": "EXACT_REFERENCE", "ACH_TRACE": "EXACT_REFERENCE", "ALLOCATION_CODE": "EXACT_REFERENCE", "AMOUNT_DATE": "WEAK_INFERENCE", "RESIDUAL": "UNATTRIBUTED",
}


def match_strength(basis: Column) -> Column:
    """The strength of a basis; null for one that there is not."""
    return _looked_up(MATCH_STRENGTH, basis)
