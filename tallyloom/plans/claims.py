"""Orders as claims: delivered as raw payloads, and taken through normalisation, crosswalk, cash and rules to verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import episodes
from tallyloom.operators.normalize import normalized
from tallyloom.plans.registry import query, tables
from tallyloom.sources.landing import shared_folder, stored

_NPI, _NDC, _BIN = "1234567893", "00011122233", "610001"
_CURSORS = ("2025-07-05T23:59:59Z", "2025-07-31T23:59:59Z")
#: Which orders are rejected, answered, paid in full, and funded.
_REJECTED, _ANSWERED, _FULL, _FUNDED = "o_orderkey % 11 = 0", "o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0", "o_orderkey % 2 = 0", "o_orderkey % 5 <> 0"


def _payload(**cells) -> Column:
    return F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in cells.items()]))


def raw_claims(spark, sf_dir) -> DataFrame:
    """A claim for every order, a remittance for two thirds of those that are not rejected, and deposits for four fifths of these; every seventh claim comes twice."""
    (orders,) = tables(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    own = key.cast("string")
    rx, paid = F.lpad(own, 9, "0"), F.when(F.expr(_FULL), F.lit("90.00")).otherwise(F.lit("45.00"))
    claim = _payload(
        record_id=F.concat(F.lit("C"), own), source_system="PBM_ADJUDICATION", transaction_code="B1", received_at="2025-07-01T10:00:00Z", service_provider_id=_NPI, prescription_ref_number=rx, fill_number="00",
        date_of_service="20250701", product_service_id=_NDC, quantity_dispensed="30000", bin=_BIN, response_status=F.when(F.expr(_REJECTED), F.lit("R")).otherwise(F.lit("P")), authorization_number=F.concat(F.lit("AUTH"), own),
    )
    line = F.struct(
        F.concat(rx, F.lit("FILL00")).alias("clp01_patient_control_number"), F.lit("1").alias("clp02_claim_status_code"), F.lit("120.00").alias("clp03_total_charge"), paid.alias("clp04_payment_amount"),
        F.concat(F.lit("ICN"), own).alias("clp07_payer_claim_control_number"), F.struct(F.lit("20250701").alias("date_of_service")).alias("service_line"),
        F.array(F.struct(F.lit("CO").alias("group_code"), F.lit("45").alias("reason_code"), F.when(F.expr(_FULL), F.lit("30.00")).otherwise(F.lit("75.00")).alias("amount"))).alias("adjustments"),
    )
    trace = F.concat(F.lit("TRN"), own)
    remittance = _payload(
        record_id=F.concat(F.lit("R"), own), source_system="PBM_REMITTANCE", received_at="2025-07-10T10:00:00Z", bpr=F.struct(paid.alias("total_actual_provider_payment"), F.lit("20250710").alias("payment_effective_date")),
        trn=F.struct(trace.alias("reassociation_trace_number")), payee_npi=_NPI, claim_payments=F.array(line),
    )
    deposit = _payload(posting_date="2025-07-11", description="ACH", ach_trace_number=F.concat(F.lit("B"), own), trn02=trace, amount=paid, type="CREDIT", received_at="2025-07-11T10:00:00Z")

    def rows(df: DataFrame, system: str, letter: str, at: str, payload) -> DataFrame:
        name = F.concat(F.lit(letter), own)
        return df.select(
            F.concat(F.lit("raw-"), name).alias("raw_id"), F.lit("orders").alias("source_id"), F.lit(system).alias("source_system"), name.alias("source_record_id"), F.lit("orders").alias("file"), key.alias("line_no"),
            F.lit(at).alias("received_at"), F.sha2(payload.cast("binary"), 256).alias("payload_sha256"), payload.alias("payload"),
        )

    answered = orders.where(_ANSWERED)
    sent = rows(orders, "PBM_ADJUDICATION", "C", "2025-07-01T10:00:00Z", claim)
    again = rows(orders.where("o_orderkey % 7 = 0"), "PBM_ADJUDICATION", "C", "2025-07-03T10:00:00Z", claim).withColumn("raw_id", F.concat("raw_id", F.lit("-again")))
    return sent.unionByName(again).unionByName(rows(answered, "PBM_REMITTANCE", "R", "2025-07-10T10:00:00Z", remittance)).unionByName(rows(answered.where(_FUNDED), "BANK", "B", "2025-07-11T10:00:00Z", deposit))


def _terms(spark) -> DataFrame:
    return spark.createDataFrame([(_BIN, _NDC, 400, 1000, 0, 1800, None, 500, 200)], "payer string, ndc string, wac_cents long, discount_bps long, fee_cents long, copay_cents long, coinsurance_bps long, acquisition_cents long, ceiling_cents long")


_VERDICTS = f"""v AS (SELECT o_orderkey, {_ANSWERED} AS answered, CASE WHEN {_REJECTED} THEN 'A-01' WHEN NOT ({_ANSWERED}) THEN 'A-02' WHEN {_FULL} THEN CASE WHEN {_FUNDED} THEN 'A-04' ELSE 'A-05' END
        ELSE CASE WHEN {_FUNDED} THEN 'A-07' ELSE 'A-08' END END AS code, CASE WHEN {_REJECTED} THEN 0 ELSE 9000 END AS expected,
        CASE WHEN {_ANSWERED} AND {_FUNDED} THEN CASE WHEN {_FULL} THEN 9000 ELSE 4500 END ELSE 0 END AS received FROM orders)"""
_STATE = "CASE code WHEN 'A-01' THEN 'CLOSED' WHEN 'A-04' THEN 'CLOSED' WHEN 'A-02' THEN 'PENDING' ELSE 'EXCEPTION' END"


@query(f"""WITH {_VERDICTS} SELECT 'PBM_ADJUDICATION:C' || o_orderkey AS episode_id, code AS reimbursement_code, 'C-00' AS rebate_code, {_STATE} AS disposition,
    CAST(expected AS BIGINT) AS expected_cents, CAST(received AS BIGINT) AS received_cents, CAST(expected - received AS BIGINT) AS variance_cents FROM v""")
def claims_to_verdicts(spark, sf_dir):
    """Every order from its raw payloads to a verdict."""
    records, _ = normalized(raw_claims(spark, sf_dir))
    found = episodes.evaluated(stored(records, "records"), _terms(spark), _CURSORS[1])["verdicts"]
    return found.select("episode_id", "reimbursement_code", "rebate_code", "disposition", "expected_cents", "received_cents", "variance_cents")


@query("""SELECT 'C' AS kind, count(*) AS records, CAST(NULL AS BIGINT) AS cents, count(DISTINCT o_orderkey) AS keys FROM orders
    UNION ALL SELECT 'L', count(*), CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 9000 ELSE 4500 END) AS BIGINT), count(*) FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0
    UNION ALL SELECT 'R', count(*), CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 9000 ELSE 4500 END) AS BIGINT), count(*) FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0
    UNION ALL SELECT 'B', count(*), CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 9000 ELSE 4500 END) AS BIGINT), count(*) FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0""")
def normalised_records(spark, sf_dir):
    """Records by kind: copies are dropped, and lines come with their remittance."""
    records, _ = normalized(raw_claims(spark, sf_dir))
    kind = F.when(F.col("record_kind") == "PHARMACY_CLAIM", "C").when(F.col("record_kind") == "REMITTANCE", "R").when(F.col("record_kind") == "REMITTANCE_CLAIM_LINE", "L").when(F.col("record_kind") == "BANK_TRANSACTION", "B")
    cents = F.sum(F.when(F.col("record_kind") != "PHARMACY_CLAIM", F.col("amount_cents")))
    return records.groupBy(kind.alias("kind")).agg(F.count("*").alias("records"), cents.alias("cents"), F.count_distinct("record_id").alias("keys"))


@query(f"""WITH {_VERDICTS} SELECT 'PBM_ADJUDICATION:C' || o_orderkey AS episode_id, '{_CURSORS[0]}' AS cursor_at, CASE WHEN {_REJECTED} THEN 'A-01' ELSE 'A-02' END AS reimbursement_code, CAST(NULL AS VARCHAR) AS reopened_from FROM orders
    UNION ALL SELECT 'PBM_ADJUDICATION:C' || o_orderkey, '{_CURSORS[1]}', code, CASE WHEN {_STATE} = 'EXCEPTION' THEN 'PENDING' END FROM v WHERE answered""")
def ledger_verdicts(spark, sf_dir):
    """Two batches of arrivals into a ledger: the second evaluates and appends the answered claims alone."""
    from tallyloom.streaming.ledger import Ledger

    records = stored(normalized(raw_claims(spark, sf_dir))[0], "records")
    book = Ledger(spark, f"{shared_folder(spark)}/engine-ledger-{uuid.uuid4().hex}", _terms(spark))
    since = ""
    for cursor in _CURSORS:
        book.advance(records.where((F.col("received_at") > since) & (F.col("received_at") <= cursor)), cursor)
        since = cursor
    return book.verdicts().select("episode_id", F.col("cursor_at").cast("string").alias("cursor_at"), "reimbursement_code", "reopened_from")
