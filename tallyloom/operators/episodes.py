"""Records to episodes to verdicts, as of a cursor: crosswalk, allocation, evidence, dimensions, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.money import expected_rebate, expected_terms
from tallyloom.operators import allocation, dimensions, matching, rules
from tallyloom.operators.crosswalk import attach
from tallyloom.operators.folds import adjusted, specific_adjustment
from tallyloom.sources.landing import stored

#: Adjustments that take money back for an earlier claim (fixed values).
RECOVERIES = ("WO", "CS", "72")
#: Records that a task folds, about: as wide rows they take several kilobytes each in memory.
TASK_RECORDS = 100_000
_ROOTS = ("REMITTANCE", "REBATE_BATCH", "BANK_TRANSACTION")


def episodes(records: DataFrame) -> DataFrame:
    """One episode for every claim or first submission; its id is that record's own id."""
    return records.where("creates IS NOT NULL").select(
        F.col("record_id").alias("episode_id"), F.col("creates").alias("track"), "npi", "rx", "fill", "ndc", "hcpcs", "payer", F.col("event_date").alias("service_date"), "entity", "quantity_milli",
        F.col("received_at").alias("created_at"), (F.exists(F.coalesce("publishes", F.array()), lambda k: k["key_type"].startswith("NATURAL_340B"))).alias("is_340b"),
    )


def crosswalk(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``attachments`` (``record_id, episode_id, attached_at``) and ``parked`` (``record_id, reason``)."""
    attached, parked = attach(*keyed_records(records))
    return stored(attached.unionByName(own_links(records)), "crosswalk"), parked


def linked_deposits(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``deposits`` (``bank_id, document_id, deposit_cents, basis``) and the bank rows that point at no document.

    A deposit points at the document whose trace or allocation code it carries, if that is one; without a code it takes
    the only document of its amount within three days that no deposit names.
    """
    bank = records.where("record_kind = 'BANK_TRANSACTION'")
    documents = records.where("record_kind IN ('REMITTANCE', 'REBATE_BATCH')")
    lookups = bank.select("record_id", F.col("received_at").alias("at"), F.explode_outer("looks_up").alias("k")).select("record_id", "at", "k.key_type", "k.key_value", F.lit(None).cast("string").alias("entity"))
    # A deposit may come before its remittance; both are known at the cursor, so a key counts whenever it was first seen.
    published = documents.select(F.explode("publishes").alias("k"), F.lit("").alias("first_seen_at"), F.col("record_id").alias("target"), F.lit(None).cast("string").alias("target_entity")).select("k.key_type", "k.key_value", "first_seen_at", "target", "target_entity")
    found = matching.resolve(lookups, published)
    kinds = documents.select(F.col("record_id").alias("target"), F.when(F.col("record_kind") == "REBATE_BATCH", "ALLOCATION_CODE").otherwise("TRN02").alias("basis"))
    named = bank.join(found.where("target IS NOT NULL").join(kinds, "target"), "record_id").select(F.col("record_id").alias("bank_id"), F.col("target").alias("document_id"), F.col("amount_cents").alias("deposit_cents"), "basis")
    keyless = bank.join(found.where("decision = 'NO_KEYS_PRESENT'").select("record_id"), "record_id", "left_semi")
    free = documents.join(named.select(F.col("document_id").alias("record_id")), "record_id", "left_anti")
    near = matching.band_match(keyless, free.withColumnRenamed("record_id", "document_id"), ["amount_cents"], "event_date", "event_date", "record_id", "document_id", 3).where("match IS NOT NULL")
    once = near.groupBy("match").agg(F.count("*").alias("n"), F.min("record_id").alias("bank_id")).where("n = 1")
    rescued = once.join(bank.select(F.col("record_id").alias("bank_id"), "amount_cents"), "bank_id").select("bank_id", F.col("match").alias("document_id"), F.col("amount_cents").alias("deposit_cents"), F.lit("AMOUNT_DATE").alias("basis"))
    deposits = stored(named.unionByName(rescued), "deposits")
    orphans = bank.join(deposits.select(F.col("bank_id").alias("record_id")), "record_id", "left_anti")
    return deposits, orphans.select(F.col("record_id").alias("bank_id"), F.col("amount_cents").alias("deposit_cents"), F.col("event_date").alias("posted_on"))


def allocations(records: DataFrame, linked: DataFrame, deposits: DataFrame) -> DataFrame:
    """Cents of every deposit by episode, with ``is_rebate``; ``linked`` are the records with their ``episode_id``, if they have any."""
    kinds = {"REMITTANCE_CLAIM_LINE": "LINE", "PROVIDER_LEVEL_ADJUSTMENT": "PLB", "REBATE_DISPENSE_LINE": "REBATE"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("record_kind"))
    children = linked.where(F.col("record_kind").isin(*kinds)).select(
        F.col("parent_id").alias("document_id"), F.col("record_id").alias("child_id"), kind.alias("kind"), "amount_cents", "episode_id"
    )
    made = allocation.plan(deposits, children)
    roots = records.where("record_kind IN ('REMITTANCE', 'REBATE_BATCH')").select(F.col("record_id").alias("document_id"), (F.col("record_kind") == "REBATE_BATCH").alias("is_rebate"))
    return made.join(roots, "document_id")


def expected_amounts(all_episodes: DataFrame, terms: DataFrame) -> DataFrame:
    """The episodes with ``expected_cents, expected_rebate_cents, is_priced``; one without terms expects nothing and is not priced.

    ``terms``: ``payer, ndc, wac_cents, discount_bps, fee_cents, copay_cents, coinsurance_bps, acquisition_cents, ceiling_cents``.
    """
    rows = all_episodes.join(terms, ["payer", "ndc"], "left")
    price = expected_terms(F.col("wac_cents"), F.col("quantity_milli"), F.col("discount_bps"), F.col("fee_cents"), F.col("copay_cents"), F.col("coinsurance_bps"))
    rebate = expected_rebate(F.col("acquisition_cents"), F.col("ceiling_cents"), F.col("quantity_milli"))
    zero = F.lit(0).cast("long")
    priced = price["expected"].isNotNull()
    return rows.select(*all_episodes.columns, F.coalesce(price["expected"], zero).alias("expected_cents"), F.when(priced, F.coalesce(rebate, zero)).otherwise(zero).alias("expected_rebate_cents"), priced.alias("is_priced"))


def evidence(records: DataFrame, attachments: DataFrame, task_records: int = TASK_RECORDS) -> DataFrame:
    """One row of folds for every episode from the records attached to it."""
    parents = records.where("record_kind IN ('REMITTANCE', 'REBATE_BATCH')").select(F.col("record_id").alias("parent_id"), F.col("event_date").alias("issued_on"))
    rows = records.join(attachments.select("record_id", "episode_id"), "record_id").join(parents, "parent_id", "left")
    return folded(rows, attachments.count(), task_records)


def folded(rows: DataFrame, many: int, task_records: int = TASK_RECORDS) -> DataFrame:
    """The folds of about ``many`` records with their ``episode_id`` and ``issued_on``, the day of their document, in a single grouped pass.

    Records are dealt by episode to tasks of about ``task_records`` each, and what is joined by episode after that comes in as many.
    """
    is_ = lambda *k: F.col("record_kind").isin(*k)
    line, plb, paid_rebate = is_("REMITTANCE_CLAIM_LINE"), is_("PROVIDER_LEVEL_ADJUSTMENT"), is_("REBATE_DISPENSE_LINE")
    rows = rows.repartition(max(1, -(-many // task_records)), "episode_id")
    arrival = F.struct("received_at", "record_id")
    issued = F.struct(F.coalesce("issued_on", "received_at"), "received_at", "record_id")
    amount = F.col("amount_cents")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    same = lambda on: F.count(F.when(on, 1)) > 1
    one = lambda on: F.min(F.when(on, F.coalesce(amount, F.lit(-(2**62))))) == F.max(F.when(on, F.coalesce(amount, F.lit(-(2**62)))))
    last = lambda on, known: F.max_by(F.when(on & F.col("status").isin(*known), F.col("status")), F.when(on & F.col("status").isin(*known), arrival))
    return rows.groupBy("episode_id").agg(
        F.max_by(F.when(F.col("creates").isNotNull(), F.col("status")), F.when(F.col("creates").isNotNull(), arrival)).alias("status"),
        F.count(F.when(line, 1)).alias("lines"), (same(line) & one(line)).alias("is_duplicate"), F.coalesce(F.sum(F.when(line, amount)), F.lit(0)).alias("paid"),
        F.coalesce(F.sum(F.when(line, F.col("charge_cents") - amount - adjusted())), F.lit(0)).alias("residual"), any_(line & specific_adjustment()).alias("any_specific"),
        any_(is_("PHARMACY_REVERSAL")).alias("reversed"), any_(plb & (amount > 0) & F.col("reason_code").isin(*RECOVERIES)).alias("recovered"), any_(plb & (F.col("reason_code") == "RA")).alias("credited"),
        any_(line & (F.col("status") == "1")).alias("settled"), any_(line & F.col("status").isin("19", "25")).alias("forwarded"),
        any_(is_("MEDICAL_ACKNOWLEDGMENT") & (F.col("status") == "REJECTED")).alias("refused"), F.min_by(F.when(line, amount), F.when(line, issued)).alias("first_paid"),
        F.min_by(F.when(line, F.col("status") == "4"), F.when(line, issued)).alias("first_denied"), any_(line & (F.col("status") == "4")).alias("any_denied"),
        any_(is_("MEDICAL_SUBMISSION") & F.col("status").isin("7", "8")).alias("appealed"), F.size(F.collect_set(F.when(line, F.col("icn")))).alias("answers"),
        any_(is_("TPA_QUALIFICATION", "TPA_REBATE_REQUEST", "TPA_MANUFACTURER_DECISION", "TPA_REVERSAL", "REBATE_DISPENSE_LINE")).alias("present"),
        last(is_("TPA_QUALIFICATION"), ("QUALIFIED", "NOT_QUALIFIED")).alias("qualification"), any_(is_("TPA_REBATE_REQUEST", "BEACON_ACKNOWLEDGMENT")).alias("requested"),
        last(is_("TPA_MANUFACTURER_DECISION"), ("APPROVED", "REJECTED", "PENDING")).alias("manufacturer"), F.count(F.when(paid_rebate, 1)).alias("rebate_lines"),
        (same(paid_rebate) & one(paid_rebate)).alias("rebate_duplicate"), F.coalesce(F.sum(F.when(paid_rebate, amount)), F.lit(0)).alias("rebate_paid"), any_(is_("TPA_REVERSAL")).alias("rebate_reversed"),
        F.min_by("beacon_id", F.when(F.col("beacon_id").isNotNull(), arrival)).alias("beacon_id"), F.array_sort(F.collect_set(F.struct("received_at", "record_id", "record_kind", "raw_id"))).alias("evidence"),
    )


def _decided(rows: DataFrame) -> DataFrame:
    c = F.col
    on = c("track") == "PHARMACY"
    common = {"lines": c("lines"), "is_duplicate": c("is_duplicate"), "paid": c("paid"), "expected": c("expected_cents"), "recovered": c("recovered")}
    ph = dimensions.pharmacy({**common, "status": c("status"), "residual": c("residual"), "any_specific": c("any_specific"), "reversed": c("reversed"), "settled": c("settled"), "forwarded": c("forwarded")})
    md = dimensions.medical({**common, "refused": c("refused"), "first_paid": c("first_paid"), "first_denied": c("first_denied"), "any_denied": c("any_denied"), "appealed": c("appealed"), "credited": c("credited"), "answers": c("answers")})
    rb = dimensions.rebate({"present": c("present"), "qualification": c("qualification"), "requested": c("requested"), "manufacturer": c("manufacturer"), "lines": c("rebate_lines"), "is_duplicate": c("rebate_duplicate"), "paid": c("rebate_paid"), "expected": c("expected_rebate_cents"), "reversed": c("rebate_reversed")})
    rows = rows.withColumns({"reimb_type": c("track"), **{k: F.when(on, v) for k, v in ph.items()}, **{k: F.when(~on, v) for k, v in md.items()}, **rb})
    won = F.coalesce((c("md_appeal") == "WON") | c("md_remittance").isin("PAID_FULL", "PARTIAL", "DUPLICATE_835"), F.lit(False))
    moved = F.when(on, F.coalesce(~c("ph_payment").isin("NONE"), F.lit(False))).otherwise(won)
    back = F.coalesce(c("ph_post_event").isin("REVERSAL_POST_PAY", "RECOUPMENT") | (c("md_post_event") == "RECOUPMENT"), F.lit(False))
    rebated = F.coalesce(c("r_payment") != "NONE", F.lit(False))
    return rows.withColumns({
        "cash_reimb_in": F.when(moved, F.coalesce(dimensions.cash_in(c("paid"), c("cash_in")), F.lit("ABSENT"))), "cash_reimb_out": F.when(back, dimensions.cash_out(c("paid"), c("cash_out"))),
        "cash_rebate_in": F.when(rebated, F.coalesce(dimensions.cash_in(c("rebate_paid"), c("rebate_in")), F.lit("ABSENT"))), "cash_rebate_out": F.when(c("r_payment") == "CLAWED_BACK", dimensions.cash_out(c("rebate_paid"), c("rebate_out"))),
    })


def keyed_records(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the crosswalk takes: look-ups, the keys of episodes, and the keys that records publish once they are attached."""
    seen = F.col("received_at").alias("first_seen_at")
    published = records.select("record_id", "creates", "entity", seen, F.explode("publishes").alias("k")).select("*", "k.key_type", "k.key_value")
    anchors = published.where("creates IS NOT NULL").select("key_type", "key_value", "first_seen_at", F.col("record_id").alias("target"), F.col("entity").alias("target_entity"))
    more = published.where("creates IS NULL").select("record_id", "key_type", "key_value")
    waiting = records.where(F.col("creates").isNull() & ~F.col("record_kind").isin(*_ROOTS))
    lookups = waiting.select("record_id", F.col("received_at").alias("at"), "entity", F.explode_outer("looks_up").alias("k")).select("record_id", "at", "k.key_type", "k.key_value", "entity")
    return lookups, anchors, more


def own_links(records: DataFrame) -> DataFrame:
    """The records that open episodes, attached to them."""
    return records.where("creates IS NOT NULL").select("record_id", F.col("record_id").alias("episode_id"), F.col("received_at").alias("attached_at"))


def decided(base: DataFrame, found: DataFrame, made: DataFrame, terms: DataFrame, cursor: str) -> DataFrame:
    """Verdicts of the episodes ``base`` from the evidence ``found`` for them and their allocations."""
    of = lambda rebate, sign: F.coalesce(F.sum(F.when((F.col("is_rebate") == rebate) & (F.col("allocated_cents") * sign > 0), F.col("allocated_cents") * sign)), F.lit(0))
    cash = made.where("episode_id IS NOT NULL").groupBy("episode_id").agg(of(False, 1).alias("cash_in"), of(False, -1).alias("cash_out"), of(True, 1).alias("rebate_in"), of(True, -1).alias("rebate_out"))
    rows = expected_amounts(base, terms).join(found, "episode_id").join(cash, "episode_id", "left").na.fill(0, ["cash_in", "cash_out", "rebate_in", "rebate_out"])
    rows = rules.composed(rules.classified(_decided(rows)), F.col("is_priced"))
    expected, rebate = rules.still_expected(F.col("expected_cents"), F.col("expected_rebate_cents"))
    return rows.select(
        "episode_id", F.lit(cursor).alias("cursor_at"), "track", "reimbursement_code", "rebate_code", "flags", "coherence", "disposition", "reasons", expected.alias("expected_cents"), F.col("cash_in").alias("received_cents"),
        (expected - F.col("cash_in")).alias("variance_cents"), rebate.alias("expected_rebate_cents"), F.col("rebate_in").alias("received_rebate_cents"), (rebate - F.col("rebate_in")).alias("variance_rebate_cents"),
        "service_date", "beacon_id", "evidence", *rules.DIMENSIONS,
    )


def evaluated(records: DataFrame, terms: DataFrame, cursor: str) -> dict[str, DataFrame]:
    """Everything that is known at a cursor: ``verdicts, allocations, deposits, orphans, attachments, parked, episodes``."""
    known = stored(records.where(F.col("received_at") <= cursor), "known_records")
    attachments, parked = crosswalk(known)
    deposits, orphans = linked_deposits(known)
    made = stored(allocations(known, known.join(attachments.select("record_id", "episode_id"), "record_id", "left"), deposits), "allocations")
    base = episodes(known)
    verdicts = decided(base, evidence(known, attachments), made, terms, cursor)
    return {"verdicts": verdicts, "allocations": made, "deposits": deposits, "orphans": orphans, "attachments": attachments, "parked": parked, "episodes": base}


def history(records: DataFrame, terms: DataFrame, cursors: list[str]) -> DataFrame:
    """Verdicts at each of a few cursors, with what every case was reopened from."""
    from tallyloom.operators.asof import carry_reopened

    out = None
    for cursor in cursors:
        rows = stored(evaluated(records, terms, cursor)["verdicts"], "verdicts")
        out = rows if out is None else out.unionByName(rows)
    return carry_reopened(out, ["episode_id"], ["cursor_at"], "disposition", "cursor_at")


