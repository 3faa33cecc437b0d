"""What a person at the desk asks for: queues, cash behind a case, reconciled money, facts of a record, bounds of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.codes import EVIDENCE_ROLES, match_strength
from tallyloom.functions.money import cents_text
from tallyloom.operators.asof import latest, visible
from tallyloom.operators.rules import RANK

#: Cents by which two amounts may differ and still be the same, by what is compared (fixed values).
TOLERANCES = {"CASH_MATCH": 0, "UNDERPAYMENT": 0, "REBATE": 0}

#: Of every kind of record: the columns that say something about it, and those that say the most.
PROJECTIONS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "PHARMACY_CLAIM": (("rx", "fill", "npi", "ndc", "payer", "status", "amount_cents", "quantity_milli", "event_date", "entity"), ("status", "amount_cents")),
    "PHARMACY_REVERSAL": (("rx", "fill", "npi", "status", "event_date"), ("rx", "fill")),
    "REMITTANCE": (("payer", "trace", "amount_cents", "event_date"), ("trace", "amount_cents")),
    "REMITTANCE_CLAIM_LINE": (("rx", "fill", "icn", "status", "charge_cents", "amount_cents", "parent_id"), ("status", "charge_cents", "amount_cents")),
    "PROVIDER_LEVEL_ADJUSTMENT": (("reason_code", "amount_cents", "trace", "parent_id"), ("reason_code", "amount_cents")),
    "MEDICAL_SUBMISSION": (("npi", "payer", "hcpcs", "ndc", "status", "charge_cents", "quantity_milli", "event_date", "icn"), ("status", "hcpcs")),
    "MEDICAL_ACKNOWLEDGMENT": (("status", "icn", "reason_code"), ("status",)),
    "TPA_QUALIFICATION": (("status", "npi", "rx", "ndc", "hcpcs", "event_date", "entity"), ("status",)),
    "TPA_REBATE_REQUEST": (("npi", "rx", "ndc", "hcpcs", "event_date", "entity"), ("event_date",)),
    "TPA_MANUFACTURER_DECISION": (("status", "reason_code", "npi", "rx", "ndc", "event_date"), ("status",)),
    "TPA_REVERSAL": (("npi", "rx", "ndc", "event_date", "entity"), ("event_date",)),
    "TPA_INVOICE_LINE": (("ndc", "rx", "npi", "event_date"), ("ndc",)),
    "REBATE_BATCH": (("trace", "amount_cents", "event_date"), ("trace", "amount_cents")),
    "REBATE_DISPENSE_LINE": (("rx", "ndc", "hcpcs", "status", "amount_cents", "parent_id"), ("status", "amount_cents")),
    "BANK_TRANSACTION": (("trace", "amount_cents", "status", "event_date"), ("amount_cents", "event_date")),
    "BEACON_ACKNOWLEDGMENT": (("beacon_id", "rx", "ndc", "event_date", "entity"), ("beacon_id",)),
    "BEACON_VALIDATION_OUTCOME": (("beacon_id", "status"), ("status",)),
    "BEACON_PAYMENT_REFERENCE": (("beacon_id",), ("beacon_id",)),
}
_lacking = sorted({*EVIDENCE_ROLES, "REMITTANCE", "REBATE_BATCH"} - PROJECTIONS.keys())
if _lacking or any(not set(essential) <= set(every) for every, essential in PROJECTIONS.values()):
    raise RuntimeError(f"kinds without a projection, or essentials outside it: {_lacking}")


def tolerance_for(kind: str) -> int:
    if kind not in TOLERANCES:
        raise ValueError(f"unknown tolerance {kind!r}; there are {sorted(TOLERANCES)}")
    return TOLERANCES[kind]


def within(kind: str, a: Column, b: Column) -> Column:
    """Whether two amounts are the same within the tolerance of their kind; null where one is."""
    return F.abs(a - b) <= tolerance_for(kind)


def projected(records: DataFrame, essential: bool = False, kind: str = "record_kind") -> DataFrame:
    """``records`` with a map ``facts`` of what the record of its kind says; absent values are left out, false and zero are not.

    A kind that has no projection fails. One map expression a kind, no join.
    """
    facts = None
    for name, (every, few) in PROJECTIONS.items():
        columns = [c for c in (few if essential else every) if c in records.columns]
        pairs = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]) if columns else F.create_map().cast("map<string,string>")
        said = F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))
        facts = F.when(F.col(kind) == name, said) if facts is None else facts.when(F.col(kind) == name, said)
    unknown = F.raise_error(F.concat(F.lit("no projection of kind "), F.coalesce(F.col(kind), F.lit("null"))))
    return records.withColumn("facts", facts.otherwise(unknown.cast("map<string,string>")))


def queue(verdicts: DataFrame, keys: list[str], order: list[str], disposition: str, cursor: Column | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The cases whose latest verdict as of the cursor is in one of the three queues; of ``ids`` alone, if they are given.

    The ids cut the history down before anything is grouped.
    """
    if disposition not in RANK:
        raise ValueError(f"unknown queue {disposition!r}; there are {list(RANK)}")
    rows = verdicts if ids is None else verdicts.join(ids.select(*keys).distinct(), keys, "left_semi")
    return latest(rows, keys, order, cursor).where(F.col("disposition") == disposition)


def quarantined(refused: DataFrame, cursor: Column) -> DataFrame:
    """Rows that could not be read and had arrived by the cursor."""
    return visible(refused, cursor, "received_at")


def cash_match(allocations: DataFrame, key: str = "episode_id") -> DataFrame:
    """``key, strength, allocations, cents``: how well the cash of each case is proven. An unknown basis fails."""
    strength = F.coalesce(match_strength(F.col("basis")), F.raise_error(F.concat(F.lit("unknown basis "), F.coalesce("basis", F.lit("null")))))
    rows = allocations.where(F.col(key).isNotNull()).withColumn("strength", strength)
    return rows.groupBy(key, "strength").agg(F.count("*").alias("allocations"), F.sum("allocated_cents").alias("cents"))


def unallocated_sample(orphans: DataFrame, order: list[str], most: int = 10) -> DataFrame:
    """The first deposits that no case has, and how many there are in all (``total``)."""
    return orphans.orderBy(*order).limit(most).crossJoin(orphans.agg(F.count("*").alias("total")))


def reconciliation(current: DataFrame) -> DataFrame:
    """``current`` verdicts with totals of the stored variances, signed and absolute, and every amount as dollars; nothing is computed anew."""
    total = F.col("variance_cents") + F.col("variance_rebate_cents")
    absolute = F.abs("variance_cents") + F.abs("variance_rebate_cents")
    rows = current.withColumns({"total_variance_cents": total, "absolute_variance_cents": absolute})
    return rows.withColumns({c.replace("_cents", "_usd"): cents_text(F.col(c)) for c in rows.columns if c.endswith("_cents")})


def bounds(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``table, rows, first, last`` of each table by its stamp: what there is, and which cursors make sense."""
    one = lambda name, df, at: df.agg(F.count("*").alias("rows"), F.min(at).cast("string").alias("first"), F.max(at).cast("string").alias("last")).select(F.lit(name).alias("table"), "*")
    return reduce(lambda a, b: a.unionByName(b), [one(n, df, at) for n, (df, at) in tables.items()])


def ordinals(df: DataFrame, items: str, out: str, place: str = "ordinal") -> DataFrame:
    """The items of a list as rows with their places, from 0."""
    return df.select(*[c for c in df.columns if c != items], F.posexplode(items).alias(place, out))


def best_round(df: DataFrame, keys: list[str], round_: str, score: str) -> DataFrame:
    """The first round of the highest score."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(round_, score), F.struct(-F.col(score), F.col(round_))).alias("_b")).select(*keys, f"_b.{round_}", f"_b.{score}")


def graded_by_both(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """What two graders have in common, each once."""
    return left.select(*columns).intersect(right.select(*columns))


def arrival_order(df: DataFrame, key: list[str], received_at: str, raw_id: str, out: str = "arrival") -> DataFrame:
    """Rows with their place in the order of arrival within a key: by stamp, and by raw id at one stamp."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(received_at, raw_id)))
