"""One case in full, or all cases at once: records, cash, keys, timeline and counts, as of a cursor.

Every part is a table with the case as a column and nothing is gathered into arrays, so a case with many records is no
large group; a reader of one case filters the parts by its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.codes import evidence_role, whole_units
from tallyloom.operators.asof import changes, latest
from tallyloom.operators.reads import timeline
from tallyloom.sources.landing import new_rows

_VERDICT = ["reimbursement_code", "rebate_code", "disposition", "reasons"]


def raw_lookup(raw: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Raw rows of the asked keys, verbatim, with ``ambiguous`` where a key has several; counted before the join."""
    wanted = raw.join(asked.select(key).distinct(), key, "left_semi")
    many = wanted.groupBy(key).agg((F.count("*") > 1).alias("ambiguous"))
    return wanted.join(many, key)


def records_of(records: DataFrame, attachments: DataFrame, raw: DataFrame, cursor: str) -> DataFrame:
    """Records of each case by ``episode_id``, what they are evidence of, and where they were delivered."""
    known = records.where(F.col("received_at") <= cursor).select("record_id", "raw_id", "record_kind", "source_system", "received_at", "event_date", "amount_cents", "status")
    place = raw.select("raw_id", "source_record_id", "file", "line_no", "payload_sha256", "payload")
    found = attachments.select("record_id", "episode_id").distinct().join(known, "record_id")
    return found.join(place, "raw_id", "left").withColumn("role", evidence_role(F.col("record_kind")))


def cash_of(allocations: DataFrame, records: DataFrame) -> DataFrame:
    """Allocations of each case with the bank row that paid and, where there is one, the kind of document."""
    bank = records.where("record_kind = 'BANK_TRANSACTION'").select(F.col("record_id").alias("bank_id"), "raw_id", "trace", F.col("received_at").alias("caused_at"), F.col("event_date").alias("posted_on"))
    parents = records.select(F.col("record_id").alias("document_id"), F.col("record_kind").alias("parent_kind"))
    return allocations.where("episode_id IS NOT NULL").join(bank, "bank_id").join(parents, "document_id", "left")


def bank_rows_of(cash: DataFrame) -> DataFrame:
    """The bank rows behind each case, each once."""
    return cash.select("episode_id", "bank_id", "raw_id", "trace", "posted_on", "caused_at").distinct()


def payment_references_of(case_records: DataFrame) -> DataFrame:
    kind = "record_kind = 'BEACON_PAYMENT_REFERENCE'"
    return case_records.where(kind).select("episode_id", "record_id", "received_at", F.get_json_object("payload", "$.payment_reference").alias("payment_reference")).distinct()


def keys_of(records: DataFrame, attachments: DataFrame, cursor: str) -> DataFrame:
    """Keys that lead to each case and when each was first seen."""
    published = records.where(F.col("received_at") <= cursor).select("record_id", "received_at", F.explode("publishes").alias("k"))
    joined = published.join(attachments.select("record_id", "episode_id").distinct(), "record_id")
    return joined.groupBy("episode_id", "k.key_type", "k.key_value").agg(F.min("received_at").alias("first_seen_at"))


def counted(cases: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """``cases`` with how many rows each part has for each; every part is counted before it is joined."""
    for name, part in parts.items():
        cases = cases.join(part.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return cases.na.fill(0, list(parts))


def dossier(records: DataFrame, raw: DataFrame, verdicts: DataFrame, found: dict[str, DataFrame], cursor: str) -> dict[str, DataFrame]:
    """``head, timeline, verdict_log, keys, records, cash`` of every case as of a cursor.

    ``found`` is what ``evaluated`` returned at that cursor, ``verdicts`` the history. ``head`` has identity, the current
    verdict and its money, and counts; a case without verdicts has nulls there.
    """
    rows = records_of(records, found["attachments"], raw, cursor)
    cash = cash_of(found["allocations"], records).where(F.col("caused_at") <= cursor)
    log = verdicts.where(F.col("cursor_at") <= cursor)
    changed = changes(log, ["episode_id"], ["cursor_at"], _VERDICT)
    money = [f"{a}_{b}cents" for a in ("expected", "received", "variance") for b in ("", "rebate_")]
    current = latest(log, ["episode_id"], ["cursor_at"]).select("episode_id", F.col("cursor_at").alias("as_of"), *_VERDICT, "flags", *money)
    identity = found["episodes"].withColumn("quantity", whole_units(F.col("quantity_milli"))).drop("quantity_milli")
    head = counted(identity.join(current, "episode_id", "left"), "episode_id", {"records": rows, "cash_allocations": cash, "verdicts_written": log, "verdict_changes": changed})
    events = timeline(
        rows.select("episode_id", F.col("received_at").alias("at"), F.lit("RECORD").alias("tag"), F.col("record_kind").alias("what"), "amount_cents"),
        cash.select("episode_id", F.col("caused_at").alias("at"), F.lit("CASH").alias("tag"), F.col("basis").alias("what"), F.col("allocated_cents").alias("amount_cents")),
        changed.select("episode_id", F.col("cursor_at").alias("at"), F.lit("VERDICT").alias("tag"), F.col("disposition").alias("what"), F.col("variance_cents").alias("amount_cents")),
    )
    return {"head": head, "timeline": events, "verdict_log": log, "keys": keys_of(records, found["attachments"], cursor), "records": rows, "cash": cash}


def new_work_items(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Work items that are not there yet, one for each case, verdict and action."""
    return new_rows(wanted, existing, ["episode_id", "from_cursor", "recommended_action"])
