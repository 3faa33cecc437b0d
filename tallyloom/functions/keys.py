"""Typed composite keys: parts joined as they came, never normalised, and null where a part cannot be used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"

#: Parts of every key type, in order.
KEY_PARTS: dict[str, tuple[str, ...]] = {
    "NCPDP_CLAIM": ("npi", "rx", "fill", "service_date"),
    "MEDICAL_CLM01": ("clm01",),
    "PAYER_ICN": ("icn",),
    "TRN02": ("trn02",),
    "ALLOCATION_CODE": ("allocation_code",),
    "NATURAL_340B_PHARMACY": ("npi", "rx", "ndc", "fill_date"),
    "NATURAL_340B_MEDICAL": ("npi", "ndc", "service_date"),
    "HCPCS_MEDICAL": ("npi", "hcpcs", "service_date"),
    "PBM_AUTH": ("authorization",),
    "BEACON_ID": ("beacon_id",),
    "COVERED_ENTITY_340B": ("covered_entity", "inner_key"),
    "PAYMENT_REFERENCE": ("reference",),
}


def composite(*parts: Column, nested: bool = False) -> Column:
    """The parts joined by a pipe; null if one is null, empty or (unless ``nested``) holds a pipe."""
    good = [p.isNotNull() & (p != "") & (F.lit(nested) | ~F.contains(p, F.lit(SEPARATOR))) for p in parts]
    ok = good[0]
    for g in good[1:]:
        ok = ok & g
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(SEPARATOR), p)
    return F.when(ok, joined)


def key(key_type: str, *parts: Column) -> Column:
    """Struct ``key_type, key_value`` of a known type, null where the value is."""
    if len(parts) != len(KEY_PARTS[key_type]):
        raise ValueError(f"{key_type} has the parts {KEY_PARTS[key_type]}")
    value = composite(*parts, nested=key_type == "COVERED_ENTITY_340B")
    return F.when(value.isNotNull(), F.struct(F.lit(key_type).alias("key_type"), value.alias("key_value")))


def keys(*items: Column) -> Column:
    """The usable ones as an array."""
    return F.filter(F.array(*items), lambda k: k.isNotNull())


def first_key(*items: Column) -> Column:
    """An array with the first usable one alone."""
    return keys(F.coalesce(*items))


def claim_number(text: Column) -> Column:
    """Struct ``rx, fill`` of ``<rx>FILL<nn>``, split at the first marker; null if a side is missing. Zeros stay."""
    at = F.instr(text, "FILL")
    rx, fill = F.substr(text, F.lit(1), at - 1), F.substr(text, at + 4)
    return F.when((at > 1) & (F.length(fill) > 0), F.struct(rx.alias("rx"), fill.alias("fill")))


def hcpcs_of(composite_text: Column) -> Column:
    """The code of an ``HC:`` composite such as ``HC:J9035:JW``; else null."""
    parts = F.split(composite_text, ":")
    return F.when((F.get(parts, F.lit(0)) == "HC") & (F.length(F.get(parts, F.lit(1))) > 0), F.get(parts, F.lit(1)))


def valid_npi(npi: Column) -> Column:
    """Ten digits that begin with 1 or 2 and close the Luhn sum over their prefixed form."""
    return F.coalesce(npi.rlike("^[12][0-9]{9}$") & F.call_function("luhn_check", F.concat(F.lit("80840"), npi)), F.lit(False))


def canonical_json(*columns: str) -> Column:
    """JSON of the columns by name, without nulls and without white space."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def present(column: Column, kind: str = "string") -> Column:
    """Null, empty texts and empty lists are absent; false and zero are present."""
    if kind == "array":
        return F.coalesce(F.size(column) > 0, F.lit(False))
    if kind == "string":
        return F.coalesce(column != "", F.lit(False))
    return column.isNotNull()
