"""Cases from delivered records to verdicts."""

import pytest
from scenario import claim, deposit, raw_rows, remittance, terms, tpa

from tallyloom.operators.allocation import unbalanced
from tallyloom.operators.episodes import evaluated, history
from tallyloom.operators.normalize import normalized

LATE = "2025-12-31T23:59:59Z"


@pytest.fixture(scope="module")
def world(spark):
    """Case 1 paid in full; 2 short in cash; 3 without cash; 4 rejected; 5 recouped; 6 with a paid rebate; 7 paid twice; 8 unpaid."""
    claims = [claim(k) for k in range(1, 9)]
    claims[3]["response_status"] = "R"
    claims[5]["submission_clarification_code"] = "20"
    sent = [
        *claims,
        dict(claims[0], received_at="2025-07-02T10:00:00Z"),
        remittance(1, [(1, 120.0, 90.0), (5, 120.0, 90.0)], 150.0, plb=[("WO", 5, 30.0)]),
        deposit(1, 150.0),
        remittance(2, [(2, 120.0, 90.0), (7, 120.0, 90.0), (7, 120.0, 90.0)], 270.0),
        deposit(2, 180.0, at="2025-07-09T10:00:00Z"),
        dict(remittance(3, [(3, 120.0, 90.0)], 90.0), bpr={"total_actual_provider_payment": 90.0, "payment_effective_date": "20250801"}),
        remittance(6, [(6, 120.0, 90.0)], 90.0),
        deposit(6, 90.0, trn=""),
        tpa(6, "QUALIFICATION_DECISION", "2025-07-03T10:00:00Z", qualification_status="QUALIFIED"),
        tpa(6, "REBATE_REQUEST", "2025-07-04T10:00:00Z"),
        tpa(6, "MANUFACTURER_DECISION", "2025-07-05T10:00:00Z", manufacturer_status="APPROVED"),
        {"record_id": "BATCH", "source_system": "MANUFACTURER_REBATE", "event_type": "REBATE_PAYMENT_BATCH", "received_at": "2025-07-20T10:00:00Z", "allocation_code": "AL1", "total_rebate_amount": 90.0, "payment_effective_date": "20250720",
         "dispenses": [{"rx_number": "0006", "ndc_11": "00011122233", "fill_date": "20250701", "pharmacy_npi": "1234567893", "covered_entity_id": "CE1", "manufacturer_status": "APPROVED", "rebate_amount": 90.0}]},
        deposit(20, 90.0, at="2025-07-21T10:00:00Z", trn="AL1", day="2025-07-21"),
        deposit(99, 12.34, trn="NOWHERE"),
        tpa(77, "QUALIFICATION_DECISION", "2025-07-03T10:00:00Z", qualification_status="QUALIFIED"),
        tpa(1, "REBATE_REQUEST", "2025-07-03T11:00:00Z", rx_number=None, pharmacy_npi=None),
        "{this is no JSON",
        dict(claim(50), received_at=None),
    ]
    records, refused = normalized(raw_rows(spark, sent))
    return records.cache(), refused, evaluated(records, terms(spark), LATE)


def test_unreadable_rows_are_quarantined_and_copies_are_not(world):
    records, refused, _ = world
    assert refused.count() == 2
    assert records.where("record_id = 'PBM_ADJUDICATION:C1'").count() == 1


def test_verdicts(world):
    rows = {r["episode_id"].split(":")[1]: r for r in world[2]["verdicts"].collect()}
    assert {k: r["reimbursement_code"] for k, r in rows.items()} == {"C1": "A-04", "C2": "A-07", "C3": "A-05", "C4": "A-01", "C5": "A-12", "C6": "A-04", "C7": "A-17", "C8": "A-02"}
    assert rows["C6"]["rebate_code"] == "C-08" and rows["C6"]["disposition"] == "CLOSED"
    assert {r["rebate_code"] for k, r in rows.items() if k != "C6"} == {"C-00"}
    assert (rows["C1"]["expected_cents"], rows["C1"]["received_cents"], rows["C1"]["variance_cents"]) == (9000, 9000, 0)
    assert (rows["C2"]["received_cents"], rows["C2"]["variance_cents"]) == (6000, 3000)
    assert rows["C4"]["expected_cents"] == 0 and rows["C4"]["reasons"] == ["REJECTED_AT_POS"]
    assert rows["C8"]["disposition"] == "PENDING"


def test_deposits_are_split_to_the_cent(world):
    out = world[2]
    assert unbalanced(out["deposits"], out["allocations"]).count() == 0
    assert [r["bank_id"] for r in out["orphans"].collect()] == ["BANK:B99"]
    basis = {r["bank_id"]: r["basis"] for r in out["deposits"].collect()}
    assert basis["BANK:B6"] == "AMOUNT_DATE" and basis["BANK:B20"] == "ALLOCATION_CODE" and basis["BANK:B2"] == "TRN02"


def test_what_fits_nothing_is_parked_with_its_reason(world):
    parked = {r["record_id"]: r["reason"] for r in world[2]["parked"].collect()}
    assert parked == {"TPA_PORTAL:TQUA77": "NO_KEY_MATCH", "TPA_PORTAL:TREB1": "NO_KEYS_PRESENT"}


def test_an_earlier_cursor_knows_less(spark, world):
    records = world[0]
    early = evaluated(records, terms(spark), "2025-07-05T23:59:59Z")["verdicts"]
    assert {r["reimbursement_code"] for r in early.collect()} == {"A-02", "A-01"}
    rows = history(records, terms(spark), ["2025-07-05T23:59:59Z", "2025-07-15T23:59:59Z"]).where("episode_id LIKE '%C2'").orderBy("cursor_at").collect()
    assert [r["disposition"] for r in rows] == ["PENDING", "EXCEPTION"]
    assert [r["reopened_from"] for r in rows] == [None, "PENDING"]


def test_medical_claim_that_is_denied_and_then_won(spark):
    base = {"source_system": "CLEARINGHOUSE_837", "clm01_patient_control_number": "M1", "billing_provider_npi": "1234567893", "date_of_service": "20250701", "loop_2010bb": {"nm103_payer_name": "ACME HEALTH"},
            "service_lines": [{"svc01_composite": "HC:J9035:JW", "svc02_charge_amount": 120.0, "units": 1}], "loop_2410": {"ndc11": "00011122233", "ctp04_quantity": "30"}}

    def answer(n, paid, status, at, icn):
        return {"record_id": f"MR{n}", "source_system": "MEDICAL_REMITTANCE", "received_at": at, "bpr": {"bpr02_total_payment": paid, "bpr16_eft_effective_date": at[:10].replace("-", "")}, "trn": {"trn02_trace_number": f"MT{n}"},
                "claim_payments": [{"clp01_patient_control_number": "M1", "clp02_status_code": status, "clp03_total_charge": 120.0, "clp04_payment_amount": paid, "clp07_payer_claim_control_number": icn, "adjustments": []}],
                "provider_level_adjustments": []}

    sent = [
        dict(base, record_id="M1", received_at="2025-07-01T10:00:00Z", clm05_3_frequency_code="1"), answer(1, 0.0, "4", "2025-07-10T10:00:00Z", "I1"),
        dict(base, record_id="M1b", received_at="2025-07-12T10:00:00Z", clm05_3_frequency_code="7", ref_f8_original_icn="I1", clm01_patient_control_number="OTHER"), answer(2, 90.0, "1", "2025-08-01T10:00:00Z", "I2"),
        dict(deposit(5, 90.0, at="2025-08-02T10:00:00Z", trn="MT2", day="2025-08-02")),
    ]
    records, refused = normalized(raw_rows(spark, sent))
    assert refused.count() == 0
    codes = [r["reimbursement_code"] for r in history(records, terms(spark), ["2025-07-05T23:59:59Z", "2025-07-11T23:59:59Z", "2025-07-20T23:59:59Z", "2025-08-10T23:59:59Z"]).orderBy("cursor_at").collect()]
    assert codes == ["B-02", "B-10", "B-11", "B-12"]
