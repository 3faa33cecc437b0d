"""Rows of vendors' exports: identity, reversals that ride on the row, and the records that a row gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.dates import iso_of_wire

REVERSED = "REVERSED"
#: Parts of a dispense's natural key, in order; gaps stay.
NATURAL = ("pharmacy_npi", "provider_npi", "rx_number", "ndc", "fill_date")


@dataclass(frozen=True)
class Export:
    """One kind of file of a vendor: which columns say what. ``money`` marks invoices, which are no decisions."""

    ndc: str
    flag: str
    reversed_at: str
    row_id: str | None = None
    stamp: str | None = None
    money: bool = False


#: Exports by the id of their source (column names are fixed values).
EXPORTS: dict[str, Export] = {
    "verity_accumulations": Export("ndc_11", "reversal_status", "reversal_received_at", "accumulation_id", "qualification_received_at"),
    "verity_invoices": Export("ndc_11", "reversal_status", "reversal_received_at", "invoice_number", "batch_received_at", money=True),
    "craneware_claims_report": Export("ndc11", "dispense_status", "reversal_date"),
}


def _of_export(pick) -> Column:
    """A column that depends on the export that a row is from; null for an unknown one."""
    out = None
    for name, e in EXPORTS.items():
        value = pick(e)
        if value is not None:
            out = F.when(F.col("source_id") == name, value) if out is None else out.when(F.col("source_id") == name, value)
    return F.lit(None).cast("string") if out is None else out


def cell(name: str) -> Column:
    """A cell of the parsed row; an empty one is null."""
    return F.nullif(F.col(f"p.{name}"), F.lit(""))


def ndc() -> Column:
    return _of_export(lambda e: cell(e.ndc))


def fill_day() -> Column:
    day = cell("fill_date")
    return F.coalesce(F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day), iso_of_wire(day))


def is_invoice() -> Column:
    return F.col("source_id").isin(*[n for n, e in EXPORTS.items() if e.money])


def is_reversed() -> Column:
    """One cell against one literal: a cell that is merely filled is no reversal."""
    return F.coalesce(_of_export(lambda e: cell(e.flag) == REVERSED), F.lit(False))


def natural_key() -> Column:
    parts = [ndc() if n == "ndc" else cell(n) for n in NATURAL]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def identity() -> Column:
    """The vendor's own id of the row; else the natural key and the row's raw id, so that two fills of a day stay two."""
    own = _of_export(lambda e: cell(e.row_id) if e.row_id else None)
    return F.concat_ws("|", F.col("source_id"), F.coalesce(own, F.concat_ws("|", natural_key(), F.col("raw_id"))))


def arrived() -> Column:
    """The later of the row's stamp and, if it is reversed, its reversal's; else when the file came."""
    stamp = _of_export(lambda e: cell(e.stamp) if e.stamp else None)
    return F.coalesce(F.greatest(stamp, F.when(is_reversed(), _of_export(lambda e: cell(e.reversed_at)))), F.col("received_at"))


def unreadable() -> Column:
    drug = ndc().isNotNull() | (~is_invoice() & cell("hcpcs").isNotNull())
    return (
        F.when(~F.coalesce(F.col("source_id").isin(*EXPORTS), F.lit(False)), "NO_ADAPTER")
        .when(~F.coalesce(drug, F.lit(False)), "NO_DRUG")
        .when(fill_day().isNull(), "UNPARSEABLE")
    )


def net_reversals(rows: DataFrame, reversed_: Column, keys: list[str]) -> DataFrame:
    """``net_effect`` of the reversed rows by key, a null part being empty text. More than one is reported and not summed away."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
    return rows.where(F.coalesce(reversed_, F.lit(False))).groupBy(*parts).agg(F.count("*").alias("net_effect"))
