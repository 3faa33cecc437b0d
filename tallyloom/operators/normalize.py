"""Raw rows to canonical records: a select for each feed, children by posexplode, and a quarantine for what cannot be read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import keys as K
from tallyloom.functions.dates import iso_of_wire
from tallyloom.operators import vendors
from tallyloom.sources.feeds import SCHEMAS
from tallyloom.sources.landing import stored

_KEYS = "array<struct<key_type:string,key_value:string>>"
#: Columns of a canonical record.
RECORD: dict[str, str] = {
    "record_id": "string", "raw_id": "string", "parent_id": "string", "record_kind": "string", "source_system": "string", "received_at": "string", "creates": "string",
    "entity": "string", "npi": "string", "rx": "string", "fill": "string", "ndc": "string", "hcpcs": "string", "payer": "string", "event_date": "string", "icn": "string",
    "status": "string", "reason_code": "string", "amount_cents": "bigint", "charge_cents": "bigint", "quantity_milli": "bigint", "beacon_id": "string", "trace": "string",
    "adjustments": "array<struct<group_code:string,reason_code:string,amount_cents:bigint>>", "publishes": _KEYS, "looks_up": _KEYS,
}


def _cents(c: Column) -> Column:
    """Cents of a decimal; one with a part of a cent makes the row unreadable."""
    scaled = c * 100
    return F.when(scaled == F.floor(scaled), scaled.cast("long"))


def _shape(df: DataFrame, kind: Column | str, **given: Column) -> DataFrame:
    given["record_kind"] = F.lit(kind) if isinstance(kind, str) else kind
    base = {"raw_id", "source_system", "received_at"}
    return df.select(*[(given[n] if n in given else F.col(n) if n in base else F.lit(None)).cast(t).alias(n) for n, t in RECORD.items()])


def _id(*more: Column | str) -> Column:
    return F.concat_ws(":", F.col("source_system"), F.col("source_record_id"), *[F.lit(m) if isinstance(m, str) else m.cast("string") for m in more])


def _adjustments(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array()), lambda a: F.struct(a["group_code"].alias("group_code"), a["reason_code"].alias("reason_code"), _cents(a["amount"]).alias("amount_cents")))


def adjudications(p: DataFrame) -> DataFrame:
    c = lambda n: F.col(f"p.{n}")
    day = iso_of_wire(c("date_of_service"))
    npi, rx, fill, ndc = c("service_provider_id"), c("prescription_ref_number"), c("fill_number"), c("product_service_id")
    claim = K.key("NCPDP_CLAIM", npi, rx, fill, day)
    is_claim = c("transaction_code") == "B1"
    rebate = F.when(c("submission_clarification_code") == "20", K.composite(npi, rx, ndc, day))
    natural = F.when(rebate.isNotNull(), F.struct(F.lit("NATURAL_340B_PHARMACY").alias("key_type"), rebate.alias("key_value")))
    scoped = K.key("COVERED_ENTITY_340B", c("covered_entity_id"), rebate)
    return _shape(
        p, F.when(is_claim, "PHARMACY_CLAIM").otherwise("PHARMACY_REVERSAL"), record_id=_id(), creates=F.when(is_claim, F.lit("PHARMACY")), entity=c("covered_entity_id"), npi=npi, rx=rx, fill=fill, ndc=ndc,
        payer=c("bin"), event_date=day, status=c("response_status"), amount_cents=_cents(c("total_amount_paid")),
        quantity_milli=F.when(c("quantity_dispensed").rlike("^[0-9]+$"), c("quantity_dispensed").cast("long")),
        publishes=F.when(is_claim, K.keys(claim, K.key("PBM_AUTH", c("authorization_number")), natural, scoped)), looks_up=F.when(~is_claim, K.keys(claim)),
    )


def _remittance(p: DataFrame, declared: Column, day: Column, trace: Column) -> DataFrame:
    return _shape(p, "REMITTANCE", record_id=_id(), event_date=iso_of_wire(day), amount_cents=_cents(declared), trace=trace, publishes=K.keys(K.key("TRN02", trace)))


def pharmacy_remittances(p: DataFrame) -> DataFrame:
    root = _remittance(p, F.col("p.bpr.total_actual_provider_payment"), F.col("p.bpr.payment_effective_date"), F.col("p.trn.reassociation_trace_number"))
    l = lambda n: F.col(f"l.{n}")  # noqa: E731, E741
    number = K.claim_number(l("clp01_patient_control_number"))
    lines = p.select("*", F.posexplode("p.claim_payments").alias("pos", "l"))
    own = _shape(
        lines, "REMITTANCE_CLAIM_LINE", record_id=_id("line", F.col("pos")), parent_id=_id(), npi=F.col("p.payee_npi"), rx=number["rx"], fill=number["fill"], icn=l("clp07_payer_claim_control_number"),
        event_date=iso_of_wire(F.col("p.bpr.payment_effective_date")), status=l("clp02_claim_status_code"), amount_cents=_cents(l("clp04_payment_amount")), charge_cents=_cents(l("clp03_total_charge")),
        adjustments=_adjustments(l("adjustments")), publishes=K.keys(K.key("PAYER_ICN", l("clp07_payer_claim_control_number"))),
        looks_up=K.keys(K.key("NCPDP_CLAIM", F.col("p.payee_npi"), number["rx"], number["fill"], iso_of_wire(l("service_line.date_of_service"))), K.key("PBM_AUTH", l("ref_authorization_number"))),
    )
    taken = p.select("*", F.posexplode("p.provider_level_adjustments").alias("pos", "l"))
    plb = _shape(
        taken, "PROVIDER_LEVEL_ADJUSTMENT", record_id=_id("plb", F.col("pos")), parent_id=_id(), reason_code=l("reason_code"), amount_cents=_cents(l("amount")), looks_up=K.keys(K.key("PBM_AUTH", l("reference_id")))
    )
    return root.unionByName(own).unionByName(plb)


def medical_submissions(p: DataFrame) -> DataFrame:
    c = lambda n: F.col(f"p.{n}")
    first = c("clm05_3_frequency_code") == "1"
    day, npi, ndc = iso_of_wire(c("date_of_service")), c("billing_provider_npi"), c("loop_2410.ndc11")
    code = F.get(F.filter(F.transform(F.coalesce(c("service_lines"), F.array()), lambda s: K.hcpcs_of(s["svc01_composite"])), lambda x: x.isNotNull()), F.lit(0))
    clm01 = K.key("MEDICAL_CLM01", c("clm01_patient_control_number"))
    natural = K.composite(npi, ndc, day)
    published = K.keys(clm01, K.key("NATURAL_340B_MEDICAL", npi, ndc, day), K.key("HCPCS_MEDICAL", npi, code, day), K.key("COVERED_ENTITY_340B", c("covered_entity_id"), natural))
    acks = p.where(c("record_type") == "277CA")
    claims = p.where(~c("record_type").eqNullSafe(F.lit("277CA")))
    submitted = _shape(
        claims, "MEDICAL_SUBMISSION", record_id=_id(), creates=F.when(first, F.lit("MEDICAL")), entity=c("covered_entity_id"), npi=npi, ndc=ndc, hcpcs=code, payer=c("loop_2010bb.nm103_payer_name"), event_date=day,
        status=c("clm05_3_frequency_code"), quantity_milli=F.when(c("loop_2410.ctp04_quantity").rlike("^[0-9]+$"), c("loop_2410.ctp04_quantity").cast("long") * 1000), publishes=published,
        looks_up=F.when(~F.coalesce(first, F.lit(False)), K.keys(clm01, K.key("PAYER_ICN", c("ref_f8_original_icn")))),
    )
    answered = _shape(
        acks, "MEDICAL_ACKNOWLEDGMENT", record_id=_id(), status=F.when(F.startswith(c("stc01_composite"), F.lit("A1")), "ACCEPTED").otherwise("REJECTED"), icn=c("payer_claim_control_number"),
        publishes=K.keys(K.key("PAYER_ICN", c("payer_claim_control_number"))), looks_up=K.keys(clm01),
    )
    return submitted.unionByName(answered)


def medical_remittances(p: DataFrame) -> DataFrame:
    day = F.col("p.bpr.bpr16_eft_effective_date")
    root = _remittance(p, F.col("p.bpr.bpr02_total_payment"), day, F.col("p.trn.trn02_trace_number"))
    l = lambda n: F.col(f"l.{n}")  # noqa: E731, E741
    lines = p.select("*", F.posexplode("p.claim_payments").alias("pos", "l"))
    own = _shape(
        lines, "REMITTANCE_CLAIM_LINE", record_id=_id("line", F.col("pos")), parent_id=_id(), icn=l("clp07_payer_claim_control_number"), event_date=iso_of_wire(day), status=l("clp02_status_code"),
        amount_cents=_cents(l("clp04_payment_amount")), charge_cents=_cents(l("clp03_total_charge")), adjustments=_adjustments(l("adjustments")),
        publishes=K.keys(K.key("PAYER_ICN", l("clp07_payer_claim_control_number"))), looks_up=K.keys(K.key("MEDICAL_CLM01", l("clp01_patient_control_number"))),
    )
    taken = p.select("*", F.posexplode("p.provider_level_adjustments").alias("pos", "l"))
    plb = _shape(
        taken, "PROVIDER_LEVEL_ADJUSTMENT", record_id=_id("plb", F.col("pos")), parent_id=_id(), reason_code=l("reason_code"), amount_cents=_cents(l("amount")), looks_up=K.keys(K.key("MEDICAL_CLM01", l("reference_icn")))
    )
    return root.unionByName(own).unionByName(plb)


def rebate_keys(npi: Column, provider: Column, rx: Column, ndc: Column, hcpcs: Column, day: Column) -> Column:
    """The first key that a dispense can have: by prescription, by provider and drug, by provider and procedure."""
    return K.first_key(K.key("NATURAL_340B_PHARMACY", npi, rx, ndc, day), K.key("NATURAL_340B_MEDICAL", provider, ndc, day), F.when(ndc.isNull(), K.key("HCPCS_MEDICAL", provider, hcpcs, day)))


#: Event types of the rebate feed and the kinds of records that they are (fixed values).
TPA_KINDS = {"QUALIFICATION_DECISION": "TPA_QUALIFICATION", "REBATE_REQUEST": "TPA_REBATE_REQUEST", "MANUFACTURER_DECISION": "TPA_MANUFACTURER_DECISION", "DISPENSE_REVERSAL": "TPA_REVERSAL"}


def rebate_events(p: DataFrame) -> DataFrame:
    c = lambda n: F.col(f"p.{n}")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in TPA_KINDS.items() for x in kv]), c("event_type"))
    single = _shape(
        p.where(c("event_type") != "REBATE_PAYMENT_BATCH"), kind, record_id=_id(), entity=c("covered_entity_id"), npi=F.coalesce(c("pharmacy_npi"), c("provider_npi")), rx=c("rx_number"), ndc=c("ndc_11"), hcpcs=c("hcpcs"),
        event_date=iso_of_wire(c("fill_date")), status=F.coalesce(c("qualification_status"), c("manufacturer_status")),
        looks_up=rebate_keys(c("pharmacy_npi"), c("provider_npi"), c("rx_number"), c("ndc_11"), c("hcpcs"), iso_of_wire(c("fill_date"))),
    )
    paid = p.where(c("event_type") == "REBATE_PAYMENT_BATCH")
    root = _shape(
        paid, "REBATE_BATCH", record_id=_id(), event_date=iso_of_wire(c("payment_effective_date")), amount_cents=_cents(c("total_rebate_amount")), trace=c("allocation_code"),
        publishes=K.keys(K.key("ALLOCATION_CODE", c("allocation_code"))),
    )
    l = lambda n: F.col(f"l.{n}")  # noqa: E731, E741
    lines = _shape(
        paid.select("*", F.posexplode("p.dispenses").alias("pos", "l")), "REBATE_DISPENSE_LINE", record_id=_id("line", F.col("pos")), parent_id=_id(), entity=l("covered_entity_id"), rx=l("rx_number"), ndc=l("ndc_11"),
        event_date=iso_of_wire(l("fill_date")), status=l("manufacturer_status"), amount_cents=_cents(l("rebate_amount")),
        looks_up=rebate_keys(l("pharmacy_npi"), l("provider_npi"), l("rx_number"), l("ndc_11"), l("hcpcs"), iso_of_wire(l("fill_date"))),
    )
    return single.unionByName(root).unionByName(lines)


def bank_rows(p: DataFrame) -> DataFrame:
    c = lambda n: F.col(f"p.{n}")
    return _shape(
        p, "BANK_TRANSACTION", record_id=F.concat_ws(":", F.lit("BANK"), F.coalesce(F.col("source_record_id"), F.col("raw_id"))), event_date=c("posting_date"), status=c("type"), amount_cents=_cents(c("amount")), trace=c("trn02"),
        looks_up=K.keys(K.key("TRN02", c("trn02")), K.key("ALLOCATION_CODE", c("trn02"))),
    )


def beacon_payloads(p: DataFrame) -> DataFrame:
    c = lambda n: F.col(f"p.{n}")
    kinds = {"acknowledgement": "BEACON_ACKNOWLEDGMENT", "validation_outcome": "BEACON_VALIDATION_OUTCOME", "payment_reference": "BEACON_PAYMENT_REFERENCE"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), c("payload_kind"))
    ack = c("payload_kind") == "acknowledgement"
    own = rebate_keys(c("pharmacy_npi"), c("provider_npi"), c("rx_number"), c("ndc_11"), F.lit(None).cast("string"), c("date_of_service"))
    beacon = K.keys(K.key("BEACON_ID", c("beacon_id")))
    return _shape(
        p, kind, record_id=F.concat_ws(":", F.lit("BEACON"), c("payload_kind"), c("beacon_id"), F.substring("payload_sha256", 1, 12)), entity=c("covered_entity_id"), rx=c("rx_number"), ndc=c("ndc_11"), event_date=c("date_of_service"),
        status=c("outcome"), beacon_id=c("beacon_id"), publishes=F.when(ack, beacon), looks_up=F.when(ack, own).otherwise(beacon),
    )


def vendor_rows(p: DataFrame) -> DataFrame:
    """A decision and, where the row is flagged, its one reversal; or a line of an invoice, which moves no verdict and has no amount."""
    day, npi, provider, rx = vendors.fill_day(), vendors.cell("pharmacy_npi"), vendors.cell("provider_npi"), vendors.cell("rx_number")
    common = {
        "received_at": vendors.arrived(), "entity": vendors.cell("covered_entity_id"), "npi": F.coalesce(npi, provider), "rx": rx, "ndc": vendors.ndc(), "hcpcs": vendors.cell("hcpcs"),
        "event_date": day, "looks_up": rebate_keys(npi, provider, rx, vendors.ndc(), vendors.cell("hcpcs"), day),
    }
    kind = F.when(vendors.is_invoice(), "TPA_INVOICE_LINE").otherwise("TPA_QUALIFICATION")
    own = _shape(p, kind, record_id=_id(), status=F.when(~vendors.is_invoice(), vendors.cell("qualification_status")), **common)
    back = p.where(vendors.is_reversed() & ~vendors.is_invoice())
    return own.unionByName(_shape(back, "TPA_REVERSAL", record_id=_id("REVERSAL"), parent_id=_id(), **common))


VENDORS = ("TPA_VERITY", "TPA_CRANEWARE")
#: Each source system's adapter; a new feed is a new entry.
ADAPTERS = {
    "PBM_ADJUDICATION": adjudications, "PBM_REMITTANCE": pharmacy_remittances, "CLEARINGHOUSE_837": medical_submissions, "MEDICAL_REMITTANCE": medical_remittances, "TPA_PORTAL": rebate_events,
    "MANUFACTURER_REBATE": rebate_events, "BANK": bank_rows, "BEACON": beacon_payloads,
    **dict.fromkeys(VENDORS, vendor_rows),
}


def _readable(system: str) -> Column:
    """Null, or why a parsed row cannot be read."""
    c = lambda n: F.col(f"p.{n}")
    if system in VENDORS:
        return vendors.unreadable()
    if system == "BANK":
        bad = F.when(c("amount").isNull() | _cents(c("amount")).isNull(), "UNPARSEABLE").when(~F.coalesce(c("posting_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)), "UNPARSEABLE")
    elif system == "BEACON":
        known = F.coalesce(c("payload_kind").isin("acknowledgement", "validation_outcome", "payment_reference"), F.lit(False))
        bad = F.when(~known, "UNKNOWN_KIND").when(~K.present(c("beacon_id")), "NO_BEACON_ID").when((c("payload_kind") == "payment_reference") & ~K.present(c("payment_reference")), "NO_PAYMENT_REFERENCE")
    else:
        bad = F.when(F.col("source_record_id").isNull() | c("received_at").isNull(), "UNPARSEABLE")
        if system in ("TPA_PORTAL", "MANUFACTURER_REBATE"):
            drug = K.present(c("ndc_11")) | K.present(c("hcpcs")) | (c("event_type") == "REBATE_PAYMENT_BATCH")
            bad = bad.when(~F.coalesce(c("event_type").isin(*TPA_KINDS, "REBATE_PAYMENT_BATCH"), F.lit(False)), "UNKNOWN_KIND").when(~F.coalesce(drug, F.lit(False)), "NO_DRUG")
        if system == "PBM_ADJUDICATION":
            bad = bad.when(~F.coalesce(c("transaction_code").isin("B1", "B2"), F.lit(False)), "UNKNOWN_KIND")
    return bad


def screened(raw: DataFrame) -> DataFrame:
    """``raw`` with the ``source_record_id`` that its adapter goes by, and ``why`` it cannot be read (null if it can). Row by row, so it takes streams too.

    Each row is parsed by the schema of its own source alone, all in one projection.
    """
    known = F.coalesce(F.col("source_system").isin(*ADAPTERS), F.lit(False))
    rows = raw.withColumns({"why": F.when(~known, "NO_ADAPTER"), "named": F.col("source_record_id")})
    for system in ADAPTERS:
        mine = F.col("source_system") == system
        rows = rows.withColumn("p", F.from_json(F.when(mine, F.col("payload")), SCHEMAS[system]))
        rows = rows.withColumn("why", F.when(mine, _readable(system)).otherwise(F.col("why")))
        if system in VENDORS:
            rows = rows.withColumn("named", F.when(mine, vendors.identity()).otherwise(F.col("named")))
        rows = rows.drop("p")
    return rows.withColumn("source_record_id", F.col("named")).drop("named")


def first_of_each(rows: DataFrame) -> DataFrame:
    """Of ``screened`` rows that repeat a source's record id the first delivery. Rows without an id, and unreadable ones, all stay."""
    own = F.when(F.col("why").isNull(), F.col("source_record_id"))
    keyed = rows.withColumn("_own", own.isNotNull()).withColumn("_key", F.coalesce(own, F.col("raw_id")))
    order = Window.partitionBy("source_system", "_own", "_key").orderBy("received_at", "raw_id")
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_own", "_key", "_n")


def adapted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``records, quarantine`` of screened rows. They lie by source system, so each adapter reads its own rows only."""
    kept = stored(rows, "screened", "source_system")
    records = []
    for system, adapt in ADAPTERS.items():
        own = kept.where((F.col("source_system") == system) & F.col("why").isNull())
        records.append(adapt(own.select("*", F.from_json("payload", SCHEMAS[system]).alias("p"))))
    refused = kept.where("why IS NOT NULL").select("raw_id", "source_system", "received_at", "why")
    return reduce(lambda a, b: a.unionByName(b), records), refused


def normalized(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``records, quarantine`` of raw rows, which are read and shuffled once for all sources. Of rows that repeat a source's record id, the first
    delivery gives records, with its children; all stay raw.

    A row of a source without an adapter is quarantined. A record whose money cannot be read in whole cents is quarantined whole.
    """
    return adapted(first_of_each(screened(raw)))
