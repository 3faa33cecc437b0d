"""Vendors' rows, codes, and cases in full."""

import json

from pyspark.sql import functions as F
from scenario import NPI, claim, deposit, raw_rows, remittance, terms

from tallyloom.functions import codes
from tallyloom.operators import cases, vendors
from tallyloom.operators.episodes import evaluated, history
from tallyloom.operators.normalize import normalized

LATE = "2025-12-31T23:59:59Z"


def exported(spark, rows):
    """Raw rows of vendors' exports: ``source_id, source_system, payload``."""
    base = raw_rows(spark, [json.dumps(p) for _, _, p in rows])
    own = spark.createDataFrame([(f"raw{i:04d}", s, y) for i, (s, y, _) in enumerate(rows)], "raw_id string, s string, y string")
    return base.join(own, "raw_id").withColumns({"source_id": F.col("s"), "source_system": F.col("y")}).drop("s", "y").select(base.columns)


def test_vendor_rows(spark):
    base = {"covered_entity_id": "CE1", "ndc_11": "00011122233", "fill_date": "20250701", "rx_number": "0001", "pharmacy_npi": NPI, "qualification_status": "QUALIFIED", "qualification_received_at": "2025-07-03T10:00:00Z"}
    plain = dict(base, accumulation_id="A1")
    back = dict(base, accumulation_id="A2", reversal_status="REVERSED", reversal_received_at="2025-07-09T10:00:00Z")
    other = {"ndc11": "00011122233", "fill_date": "2025-07-01", "pharmacy_npi": NPI, "dispense_status": "DISPENSED"}
    sent = [
        ("verity_accumulations", "TPA_VERITY", plain), ("verity_accumulations", "TPA_VERITY", plain), ("verity_accumulations", "TPA_VERITY", back),
        ("verity_invoices", "TPA_VERITY", dict(back, invoice_number="I1", invoice_line_amount="12.00")), ("craneware_claims_report", "TPA_CRANEWARE", other), ("craneware_claims_report", "TPA_CRANEWARE", other),
        ("verity_accumulations", "TPA_VERITY", dict(base, ndc_11="")), ("unknown", "TPA_VERITY", base), ("s", "NOBODY", base), ("verity_accumulations", "TPA_VERITY", dict(base, fill_date="soon")),
    ]
    records, refused = normalized(exported(spark, sent))
    rows = [(r["record_id"], r["record_kind"], r["received_at"], r["amount_cents"], r["status"]) for r in records.collect()]
    named = {r[0]: r[1:] for r in rows}
    assert len(rows) == 6
    assert named["TPA_VERITY:verity_accumulations|A1"] == ("TPA_QUALIFICATION", "2025-07-03T10:00:00Z", None, "QUALIFIED")
    assert named["TPA_VERITY:verity_accumulations|A2:REVERSAL"] == ("TPA_REVERSAL", "2025-07-09T10:00:00Z", None, None)
    assert named["TPA_VERITY:verity_invoices|I1"] == ("TPA_INVOICE_LINE", "2025-07-09T10:00:00Z", None, None)
    assert sum(k.startswith("TPA_CRANEWARE") for k in named) == 2
    assert sorted(r["why"] for r in refused.collect()) == ["NO_ADAPTER", "NO_ADAPTER", "NO_DRUG", "UNPARSEABLE"]


def test_a_vendor_row_and_a_feed_row_of_one_dispense_have_one_key(spark):
    row = {"ndc_11": "00011122233", "fill_date": "20250701", "rx_number": "0001", "pharmacy_npi": NPI, "accumulation_id": "A1"}
    looks_up = normalized(exported(spark, [("verity_accumulations", "TPA_VERITY", row)]))[0].first()["looks_up"]
    published = normalized(raw_rows(spark, [claim(1, submission_clarification_code="20")]))[0].first()["publishes"]
    assert looks_up and looks_up[0] in published


def test_net_reversals_with_gaps(spark):
    rows = spark.createDataFrame([("a", None, "R"), ("a", None, "R"), ("a", "x", None), ("b", "x", "R")], "k string, l string, flag string")
    assert sorted(map(tuple, vendors.net_reversals(rows, F.col("flag") == "R", ["k", "l"]).collect())) == [("a", "", 2), ("b", "x", 1)]


def test_codes(spark):
    one = spark.range(1)
    got = one.select(
        codes.reject_meaning(F.lit("NCPDP_NUMERIC"), F.lit("70")), codes.reject_meaning(F.lit("CASCADE_ALPHA"), F.lit("A1")), codes.reject_meaning(F.lit("CASCADE_ALPHA"), F.lit("70")),
        codes.adjustment_meaning(F.lit("PR"), F.lit("3")), codes.provider_level_sign(F.lit("RA")), codes.provider_level_traceable(F.lit("FB")), codes.claim_state(F.lit("22")),
        codes.evidence_role(F.lit("TPA_REVERSAL")), codes.evidence_role(F.lit("NEW")), codes.whole_units(F.lit(30999)), codes.claim_state(F.lit(None).cast("string")),
    ).first()
    assert tuple(got) == ("NOT_COVERED", "NOT_COVERED", None, "COPAY", -1, False, "REVERSAL", "REVERSAL", "ADJUDICATION", 30, None)
    assert set(codes.REJECTS["NCPDP_NUMERIC"].values()) == set(codes.REJECTS["CASCADE_ALPHA"].values())


def test_dossier(spark):
    sent = [claim(1), claim(2), remittance(1, [(1, 120.0, 90.0)], 90.0), deposit(1, 90.0)]
    raw = raw_rows(spark, sent)
    records = normalized(raw)[0].cache()
    cursors = ["2025-07-05T23:59:59Z", "2025-07-06T23:59:59Z", LATE]
    verdicts = history(records, terms(spark), cursors)
    out = cases.dossier(records, raw, verdicts, evaluated(records, terms(spark), LATE), LATE)
    head = {r["episode_id"].split(":")[1]: r for r in out["head"].collect()}
    assert (head["C1"]["records"], head["C1"]["cash_allocations"], head["C1"]["verdicts_written"], head["C1"]["verdict_changes"]) == (2, 1, 3, 2)
    assert (head["C2"]["records"], head["C2"]["cash_allocations"], head["C2"]["disposition"], head["C2"]["quantity"]) == (1, 0, "PENDING", 30)
    assert (head["C1"]["reimbursement_code"], head["C1"]["received_cents"], head["C1"]["as_of"]) == ("A-04", 9000, LATE)
    events = sorted((r["at"], r["tag"]) for r in out["timeline"].collect() if r["episode_id"].endswith("C1"))
    assert [t for _, t in events] == ["RECORD", "VERDICT", "RECORD", "CASH", "VERDICT"]
    assert {r["role"] for r in out["records"].collect()} == {"ADJUDICATION", "REMITTANCE_CLAIM_LINE"}
    bank = cases.bank_rows_of(out["cash"]).collect()
    assert [(r["bank_id"], r["trace"]) for r in bank] == [("BANK:B1", "TRN1")]
    assert {r["key_type"] for r in out["keys"].collect()} >= {"NCPDP_CLAIM", "PAYER_ICN", "PBM_AUTH"}
    early = cases.dossier(records, raw, verdicts, evaluated(records, terms(spark), cursors[0]), cursors[0])["head"].where("episode_id LIKE '%C1'").first()
    assert (early["records"], early["cash_allocations"], early["verdicts_written"]) == (1, 0, 1)


def test_lookup_of_raw_rows_and_work_items(spark):
    raw = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r3", "b"), ("r4", "c")], "raw_id string, source_record_id string")
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("zz",)], "source_record_id string")
    got = sorted((r["raw_id"], r["ambiguous"]) for r in cases.raw_lookup(raw, asked, "source_record_id").collect())
    assert got == [("r1", True), ("r2", True), ("r3", False)]
    items = spark.createDataFrame([("e", "t", "CALL"), ("e", "t", "CALL"), ("e", "u", "CALL")], "episode_id string, from_cursor string, recommended_action string")
    assert cases.new_work_items(items, items.limit(1)).count() == 1
