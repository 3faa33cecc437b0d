"""From the evidence of an episode to its dimensions, one CASE chain each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def payment_state(lines: Column, duplicate: Column, paid: Column, expected: Column) -> Column:
    none = F.coalesce(lines, F.lit(0)) == 0
    return (
        F.when(none, "NONE").when(_no(duplicate), "DUPLICATE").when(paid > expected, "OVER").when(paid == expected, "FULL").when(paid > 0, "PARTIAL").otherwise("NONE")
    )


def cash_in(declared: Column, received: Column) -> Column:
    """Null unless money was declared; then whether it came."""
    asked = F.coalesce(declared, F.lit(0)) != 0
    return F.when(asked, F.when(received == 0, "ABSENT").when(received >= declared, "MATCHED").otherwise("PARTIAL"))


def cash_out(declared: Column, received: Column) -> Column:
    """Null unless money had to go back; any outflow matches."""
    return F.when(F.coalesce(declared, F.lit(0)) != 0, F.when(received > 0, "MATCHED").otherwise("ABSENT"))


def pharmacy(e: dict[str, Column]) -> dict[str, Column]:
    """``ph_*`` from ``status, lines, is_duplicate, paid, residual, expected, any_specific, reversed, recovered, settled, forwarded``."""
    on = F.coalesce(e["status"] == "P", F.lit(False))
    payment = payment_state(e["lines"], e["is_duplicate"], e["paid"], e["expected"])
    post = (
        F.when(_no(e["reversed"]), F.when(payment == "NONE", "REVERSAL_PRE_PAY").otherwise("REVERSAL_POST_PAY")).when(_no(e["recovered"]), "RECOUPMENT")
        .when((e["residual"] == 0) & _no(e["any_specific"]), "ADJUSTMENT").otherwise("NONE")
    )
    settled = F.when(_no(e["settled"]), "CONFIRMED").when(_no(e["forwarded"]), "MISSING").otherwise("CONFIRMED")
    return {
        "ph_adjudication": F.when(on, "ACCEPTED").otherwise("REJECTED"),
        "ph_payment": F.when(on, payment),
        "ph_post_event": F.when(on, post),
        "ph_settlement": F.when(on & (payment != "NONE") & (post != "REVERSAL_POST_PAY"), settled),
    }


def medical(e: dict[str, Column]) -> dict[str, Column]:
    """``md_*`` from ``refused, lines, is_duplicate, first_paid, first_denied, any_denied, paid, expected, appealed, credited, answers, recovered``."""
    on = ~_no(e["refused"])
    remittance = (
        F.when(F.coalesce(e["lines"], F.lit(0)) == 0, "NONE").when(_no(e["is_duplicate"]) & (e["first_paid"] != 0), "DUPLICATE_835").when(_no(e["first_denied"]), "DENIED")
        .when((e["first_paid"] >= e["expected"]) & (e["expected"] > 0), "PAID_FULL").when(e["first_paid"] > 0, "PARTIAL").when(_no(e["any_denied"]), "DENIED").otherwise("NONE")
    )
    won = _no((e["paid"] >= e["expected"]) & (e["expected"] > 0)) | _no(e["credited"])
    appeal = F.when(~_no(e["appealed"]) & ~_no(e["credited"]), "NOT_FILED").when(won, "WON").when(e["answers"] > 1, "LOST").otherwise("PENDING")
    appeal = F.when(remittance.isin("PARTIAL", "DENIED"), appeal)
    received = remittance.isin("PAID_FULL", "PARTIAL", "DUPLICATE_835") | _no(appeal == "WON")
    return {
        "md_clearinghouse": F.when(on, "ACCEPTED").otherwise("REJECTED"),
        "md_remittance": F.when(on, remittance),
        "md_appeal": F.when(on, appeal),
        "md_post_event": F.when(on & received, F.when(_no(e["recovered"]), "RECOUPMENT").otherwise("NONE")),
    }


def rebate(e: dict[str, Column]) -> dict[str, Column]:
    """``r_*`` from ``present, qualification, requested, manufacturer, lines, is_duplicate, paid, expected, reversed``: a chain of gates."""
    present = _no(e["present"])
    qualification = F.coalesce(e["qualification"], F.lit("PENDING"))
    asked = present & (qualification == "QUALIFIED")
    sent = asked & _no(e["requested"])
    answer = F.coalesce(e["manufacturer"], F.when(F.coalesce(e["lines"], F.lit(0)) > 0, "APPROVED"), F.lit("PENDING"))
    payment = (
        F.when(_no(e["reversed"]) & _no(e["paid"] > 0), "CLAWED_BACK").when(F.coalesce(e["lines"], F.lit(0)) == 0, "NONE").when(_no(e["is_duplicate"]), "DUPLICATE")
        .when((e["paid"] >= e["expected"]) & (e["expected"] > 0), "FULL").when(e["paid"] > 0, "PARTIAL").otherwise("NONE")
    )
    return {
        "r_present": F.when(present, "PRESENT").otherwise("ABSENT"),
        "r_qualification": F.when(present, qualification),
        "r_request": F.when(asked, F.when(_no(e["requested"]), "SUBMITTED").otherwise("NOT_SUBMITTED")),
        "r_manufacturer": F.when(sent, answer),
        "r_payment": F.when(sent & (answer == "APPROVED"), payment),
    }
