"""Invented records of a few cases, written as the feeds would deliver them."""

import json

NPI, BIN = "1234567893", "610001"


def claim(n, at="2025-07-01T10:00:00Z", **more):
    return {
        "record_id": f"C{n}", "source_system": "PBM_ADJUDICATION", "transaction_code": "B1", "received_at": at, "service_provider_id": NPI, "prescription_ref_number": f"000{n}", "fill_number": "00", "date_of_service": "20250701",
        "product_service_id": "00011122233", "quantity_dispensed": "30000", "bin": BIN, "response_status": "P", "authorization_number": f"AUTH{n}", "total_amount_paid": 90.00, "covered_entity_id": "CE1", **more,
    }


def remittance(n, lines, total, at="2025-07-10T10:00:00Z", plb=()):
    return {
        "record_id": f"R{n}", "source_system": "PBM_REMITTANCE", "received_at": at, "bpr": {"total_actual_provider_payment": total, "payment_effective_date": "20250710"}, "trn": {"reassociation_trace_number": f"TRN{n}"}, "payee_npi": NPI,
        "claim_payments": [{
            "clp01_patient_control_number": f"000{k}FILL00", "clp02_claim_status_code": "1", "clp03_total_charge": charge, "clp04_payment_amount": paid, "clp07_payer_claim_control_number": f"ICN{k}",
            "ref_authorization_number": f"AUTH{k}", "service_line": {"date_of_service": "20250701"}, "adjustments": [{"group_code": "CO", "reason_code": "45", "amount": round(charge - paid, 2)}],
        } for k, charge, paid in lines],
        "provider_level_adjustments": [{"reason_code": c, "reference_id": f"AUTH{k}", "amount": a} for c, k, a in plb],
    }


def deposit(n, amount, at="2025-07-11T10:00:00Z", trn=None, day="2025-07-11"):
    return {"source_system": "BANK", "record_id": f"B{n}", "posting_date": day, "description": "ACH", "trn02": f"TRN{n}" if trn is None else trn or None, "amount": amount, "type": "CREDIT", "received_at": at}


def tpa(n, kind, at, **more):
    return {
        "record_id": f"T{kind[:3]}{n}", "source_system": "TPA_PORTAL", "event_type": kind, "received_at": at, "rx_number": f"000{n}", "ndc_11": "00011122233", "fill_date": "20250701", "pharmacy_npi": NPI, "covered_entity_id": "CE1", **more,
    }


def raw_rows(spark, payloads):
    rows = []
    for i, p in enumerate(payloads):
        text = p if isinstance(p, str) else json.dumps(p)
        own = {} if isinstance(p, str) else p
        system = own.get("source_system", "PBM_ADJUDICATION")
        rows.append((f"raw{i:04d}", "s", system, own.get("record_id"), "f", i, own.get("received_at", "2025-07-01T00:00:00Z"), f"{i:064d}", text))
    from tallyloom.streaming.incremental import RAW_SCHEMA

    return spark.createDataFrame(rows, RAW_SCHEMA)


def terms(spark):
    return spark.createDataFrame(
        [(BIN, "00011122233", 400, 1000, 0, 1800, None, 500, 200), ("ACME HEALTH", "00011122233", 400, 1000, 0, 1800, None, 500, 200)],
        "payer string, ndc string, wac_cents long, discount_bps long, fee_cents long, copay_cents long, coinsurance_bps long, acquisition_cents long, ceiling_cents long",
    )
