"""Feeds as raw rows: one row a delivered record, its payload verbatim, with explicit schemas for reading it later."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources import files

#: JSON of each feed; money is decimal and never double.
_MONEY = "decimal(24,6)"
SCHEMAS: dict[str, str] = {
    "PBM_ADJUDICATION": f"""record_id string, source_system string, transaction_code string, received_at string, service_provider_id string, prescription_ref_number string,
        fill_number string, date_of_service string, product_service_id string, quantity_dispensed string, bin string, submission_clarification_code string,
        response_status string, authorization_number string, covered_entity_id string, total_amount_paid {_MONEY}, reversal_reason string""",
    "PBM_REMITTANCE": f"""record_id string, source_system string, received_at string, bpr struct<total_actual_provider_payment:{_MONEY},payment_effective_date:string>,
        trn struct<reassociation_trace_number:string>, payer_name string, payee_npi string,
        claim_payments array<struct<clp01_patient_control_number:string,clp02_claim_status_code:string,clp03_total_charge:{_MONEY},clp04_payment_amount:{_MONEY},
            clp07_payer_claim_control_number:string,ref_authorization_number:string,service_line:struct<date_of_service:string>,
            adjustments:array<struct<group_code:string,reason_code:string,amount:{_MONEY}>>>>,
        provider_level_adjustments array<struct<reason_code:string,reference_id:string,amount:{_MONEY}>>""",
    "CLEARINGHOUSE_837": f"""record_id string, source_system string, record_type string, received_at string, clm01_patient_control_number string, clm05_3_frequency_code string,
        ref_f8_original_icn string, billing_provider_npi string, date_of_service string, loop_2010bb struct<nm103_payer_name:string>,
        service_lines array<struct<svc01_composite:string,svc02_charge_amount:{_MONEY},units:int>>, loop_2410 struct<ndc11:string,ctp04_quantity:string>,
        covered_entity_id string, stc01_composite string, payer_claim_control_number string""",
    "MEDICAL_REMITTANCE": f"""record_id string, source_system string, received_at string, bpr struct<bpr02_total_payment:{_MONEY},bpr16_eft_effective_date:string>,
        trn struct<trn02_trace_number:string>,
        claim_payments array<struct<clp01_patient_control_number:string,clp02_status_code:string,clp03_total_charge:{_MONEY},clp04_payment_amount:{_MONEY},
            clp07_payer_claim_control_number:string,adjustments:array<struct<group_code:string,reason_code:string,amount:{_MONEY}>>>>,
        provider_level_adjustments array<struct<reason_code:string,reference_icn:string,amount:{_MONEY}>>""",
    "TPA_PORTAL": f"""record_id string, source_system string, event_type string, received_at string, rx_number string, ndc_11 string, hcpcs string, fill_date string, pharmacy_npi string,
        provider_npi string, covered_entity_id string, qualification_status string, manufacturer_status string, allocation_code string, total_rebate_amount {_MONEY},
        payment_effective_date string, dispenses array<struct<rx_number:string,ndc_11:string,hcpcs:string,fill_date:string,pharmacy_npi:string,provider_npi:string,
            covered_entity_id:string,manufacturer_status:string,rebate_amount:{_MONEY}>>""",
    "BANK": f"""posting_date string, description string, ach_trace_number string, trn02 string, company_name string, amount {_MONEY}, type string, received_at string""",
    "BEACON": """payload_kind string, direction string, beacon_id string, covered_entity_id string, received_at string, rx_number string, pharmacy_npi string, provider_npi string,
        ndc_11 string, date_of_service string, outcome string, decided_at string, payment_reference string, batch_received_at string""",
}
SCHEMAS["MANUFACTURER_REBATE"] = SCHEMAS["TPA_PORTAL"]
#: The vendors' exports have one schema; a cell that an export lacks is null.
SCHEMAS["TPA_VERITY"] = """covered_entity_id string, ndc_11 string, ndc11 string, dispense_status string, reversal_date string, hcpcs string, fill_date string, rx_number string, pharmacy_npi string, provider_npi string, accumulation_id string,
    invoice_number string, qualification_status string, qualification_received_at string, batch_received_at string, reversal_status string, reversal_received_at string"""
SCHEMAS["TPA_CRANEWARE"] = SCHEMAS["TPA_VERITY"]
BANK_COLUMNS = ["posting_date", "description", "ach_trace_number", "trn02", "company_name", "company_id", "company_entry_description", "amount", "type", "running_balance", "received_at"]

#: What names a record in formats that have no ``record_id``.
OWN_IDS = {"BANK_CSV": "ach_trace_number"}


@dataclass(frozen=True)
class Source:
    """A place that records come from: data and no code."""

    source_id: str
    source_system: str
    payload_format: str
    paths: tuple[str, ...]
    received_at_field: str | None = "received_at"
    enabled: bool = True
    renames: dict[str, str] = field(default_factory=dict)
    own_id: str | None = None
    reversal: tuple[str, str] | None = None


def enabled(sources: list[Source]) -> list[Source]:
    return [s for s in sources if s.enabled]


def by_id(sources: list[Source], source_id: str) -> Source:
    found = [s for s in sources if s.source_id == source_id]
    if not found:
        raise KeyError(source_id)
    return found[0]


def _raw(df: DataFrame, source: Source, fetched_at: str) -> DataFrame:
    """Raw rows. Their id is the file's hash and the row's number, so rows of files that differ never share one."""
    field_ = source.received_at_field
    stamp = F.nullif(F.get_json_object("payload", f"$.{field_}"), F.lit("")) if field_ else F.lit(None).cast("string")
    author = F.coalesce(F.get_json_object("payload", "$.source_system"), F.lit(source.source_system))
    own = F.get_json_object("payload", f"$.{source.own_id or OWN_IDS.get(source.payload_format, 'record_id')}")
    return df.select(
        F.concat_ws(":", F.lit(source.source_id), F.substring("file_sha256", 1, 24), F.col("line_no").cast("string")).alias("raw_id"),
        F.lit(source.source_id).alias("source_id"), author.alias("source_system"), own.alias("source_record_id"), "file", "line_no",
        F.coalesce(stamp, F.lit(fetched_at)).alias("received_at"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"), "payload",
    )


def is_epoch(stamp: str) -> bool:
    """Whether a stamp names the instant 1970-01-01T00:00Z in any spelling; one without a zone is UTC, and no ISO date is none."""
    try:
        at = datetime.fromisoformat(stamp.strip())
    except ValueError:
        return False
    return (at if at.tzinfo else at.replace(tzinfo=UTC)) == datetime.fromtimestamp(0, UTC)


def read_jsonl(spark: SparkSession, source: Source, fetched_at: str) -> DataFrame:
    """Each line that is not blank is a record."""
    return _raw(files.read_lines(spark, source.paths), source, fetched_at)


def read_bank_csv(spark: SparkSession, source: Source, fetched_at: str) -> DataFrame:
    """Rows of the bank's files as JSON with sorted keys; an empty cell is null and left out. A header with other columns is refused."""
    return _raw(files.read_delimited(spark, source.paths, tuple(BANK_COLUMNS)), source, fetched_at)


def read_vendor_csv(spark: SparkSession, source: Source, fetched_at: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows of a vendor's exports, and ``file, line_no, record_type, record_count`` of all rows for the control totals.

    Every row lands but the trailers, whatever its type is, an empty one included. Where no column says when a row came, the delivery's own stamp has
    to, and a stamp of the epoch says nothing: the load is refused.
    """
    if source.received_at_field is None and is_epoch(fetched_at):
        raise MissingDeliveryStamp(f"{source.source_id} has no column of arrival, and the delivery's stamp {fetched_at!r} is the epoch")
    rows = files.read_delimited(spark, source.paths, None, source.renames)
    landed = rows.where(~F.col("record_type").eqNullSafe(files.TRAILER))
    return _raw(landed, source, fetched_at), rows.select("file", "line_no", "record_type", "record_count")


class MissingDeliveryStamp(ValueError):
    """Rows would be dated 1970, before everything that they could match."""


READERS = {"JSONL": read_jsonl, "BANK_CSV": read_bank_csv, "VENDOR_CSV": lambda *a: read_vendor_csv(*a)[0]}


def read(spark: SparkSession, sources: list[Source], fetched_at: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """All enabled sources as one table of raw rows, without those of excluded authors; an unknown format or author is refused."""
    known = tuple(SCHEMAS)
    unknown = {s.payload_format for s in sources} - set(READERS)
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    out = None
    for s in enabled(sources):
        rows = READERS[s.payload_format](spark, s, fetched_at)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no source is enabled")
    author = F.when(F.col("source_system").isin(*known), F.col("source_system")).otherwise(F.raise_error(F.concat(F.lit("unknown source system "), F.col("source_system"))))
    out = out.withColumn("source_system", author)
    return out.where(~F.col("source_system").isin(*exclude)) if exclude else out


def new_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (``source_id, name, modified_at, sha256``) to fetch: not those whose content or known, equal time was seen."""
    fresh = files.join(seen.select("sha256"), "sha256", "left_anti")
    known = seen.where("modified_at IS NOT NULL").select("source_id", "name", "modified_at")
    return fresh.join(known, ["source_id", "name", "modified_at"], "left_anti")
