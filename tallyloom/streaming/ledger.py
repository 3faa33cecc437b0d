"""Verdicts as arrivals go on: each batch evaluates the cases that it touches, and appends what it finds.

A case can change only if a record attaches to it (or no longer does), or if a deposit of one of its documents does, for age is no input of a rule.
The delta goes record, document, deposit, document, cases: the batch's own records and links, documents of newly linked lines, deposits that now
point elsewhere, and then every case with a line on such a document, as a split over a document's lines changes for all of them. Only
those cases' records and their documents' other lines are read for the evaluation. Deposits are matched over bank rows and
documents alone; lines, which are most of the records, are read by kind and by parent.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.codes import MATCH_STRENGTH
from tallyloom.operators import rules
from tallyloom.operators.asof import latest
from tallyloom.operators.episodes import allocations, decided, episodes, folded, keyed_records, linked_deposits, own_links
from tallyloom.operators.normalize import RECORD
from tallyloom.sources.landing import discard, stored
from tallyloom.streaming.pool import Pool

ROOTS = ("REMITTANCE", "REBATE_BATCH", "BANK_TRANSACTION")


class RefusedAppend(ValueError):
    """Rows that the table's vocabulary or its keys do not allow; nothing of them is written."""


def verdict_faults(verdicts: DataFrame) -> DataFrame:
    """``episode_id, cursor_at, fault`` of verdicts that may not be appended."""
    codes = list(rules.DISPOSITIONS)
    reasons = sorted({w for _, why in rules.DISPOSITIONS.values() for w in why} | {w for why, _ in rules.FLAG_EFFECTS.values() for w in why} | {"INSUFFICIENT_DATA"})
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    outside = lambda c, values: F.size(F.array_except(F.coalesce(c, F.array(F.lit("null"))), F.array(*map(F.lit, values)))) > 0
    rebate_open = F.coalesce(F.col("rebate_code") != "C-00", F.lit(False))
    tests = {
        "KEY": F.col("episode_id").isNull() | F.col("cursor_at").isNull(),
        "REIMBURSEMENT_CODE": ~known("reimbursement_code", [c for c in codes if c[0] in "AB"]), "REBATE_CODE": ~known("rebate_code", [c for c in codes if c[0] == "C"]),
        "DISPOSITION": ~known("disposition", list(rules.RANK)), "REASON": outside(F.col("reasons"), reasons), "FLAG": outside(F.col("flags"), list(rules.FLAG_EFFECTS)),
        "REOPENED_FROM": F.coalesce(~F.col("reopened_from").isin("CLOSED", "PENDING"), F.lit(False)), "ABSENT_TRACK": ~rebate_open & (F.col("received_rebate_cents") != 0) & (F.col("r_present") == "ABSENT"),
    }
    wrong = verdicts.select("episode_id", "cursor_at", F.explode(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda f: f.isNotNull())).alias("fault"))
    twice = verdicts.groupBy("episode_id", "cursor_at").agg(F.count("*").alias("n")).where("n > 1").select("episode_id", "cursor_at", F.lit("UNIQUE").alias("fault"))
    return wrong.unionByName(twice)


def append_verdicts(verdicts: DataFrame, path: str) -> None:
    """Appends verdicts of one cursor, all or none; the cursor's own files are replaced, so doing it again changes nothing."""
    faults = verdict_faults(verdicts)
    found = faults.groupBy("fault").agg(F.count("*").alias("n"), F.min("episode_id").alias("such_as")).orderBy("fault").collect()
    if found:
        raise RefusedAppend("; ".join(f"{r['fault']}: {r['n']} verdicts such as {r['such_as']}" for r in found))
    verdicts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cursor_at").parquet(path)


def append_allocations(rows: DataFrame, path: str) -> None:
    """Appends planned cents by the cursor of their batch; an unknown basis is refused."""
    wrong = rows.where(~F.coalesce(F.col("basis").isin(*MATCH_STRENGTH), F.lit(False)))
    if not wrong.isEmpty():
        raise RefusedAppend(f"unknown basis: {[r[0] for r in wrong.select('basis').distinct().limit(5).collect()]}")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cursor_at").parquet(path)


class Ledger:
    """Records, links, deposits, verdicts under ``folder``, and the evaluation of what each batch touches."""

    def __init__(self, spark: SparkSession, folder: str, terms: DataFrame) -> None:
        self.spark, self.folder, self.terms = spark, folder.rstrip("/"), terms
        self.pool = Pool(spark, f"{self.folder}/pool")
        self.evaluated: int | None = None

    def _read(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _put(self, df: DataFrame, name: str, *parts: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.folder}/{name}")

    def verdicts(self) -> DataFrame:
        """Every verdict appended so far; ``asof.latest`` by ``cursor_at`` gives what held at a cursor."""
        return self.spark.read.parquet(f"{self.folder}/verdicts")

    def advance(self, batch: DataFrame, cursor: str) -> int:
        """Takes in the normalised records that arrived up to ``cursor``; returns how many cases were evaluated.

        Cursors rise from call to call. A call that is repeated does its work again and leaves the same tables.
        """
        step = int(datetime.fromisoformat(cursor).timestamp())
        schema = ", ".join(f"{n} {t}" for n, t in RECORD.items()) + ", at_cursor string"
        self._put(batch.where(F.col("received_at") <= cursor).withColumn("at_cursor", F.lit(cursor)), "records", "record_kind", "at_cursor")
        records = self._read("records", schema).where(F.col("at_cursor") <= cursor)
        batch = records.where(F.col("at_cursor") == cursor)
        every = keyed_records(records)
        moved = self.pool.advance(*keyed_records(batch), everything=(every[0], every[2]), step=step)
        links = self.pool.attachments().select("record_id", "episode_id").unionByName(own_links(records).select("record_id", "episode_id"))
        # Deposits: matched among bank rows and documents, and compared with what they pointed at before.
        roots = records.where(F.col("record_kind").isin(*ROOTS))
        deposits, _ = linked_deposits(roots)
        before = self._read("deposits", "bank_id string, document_id string, deposit_cents long, basis string, at_cursor string").where(F.col("at_cursor") < cursor)
        last = before.agg(F.max("at_cursor")).first()[0]
        before = before.where(F.col("at_cursor") == last).drop("at_cursor") if last else before.drop("at_cursor")
        self._put(deposits.withColumn("at_cursor", F.lit(cursor)), "deposits", "at_cursor")
        differ = deposits.exceptAll(before).unionByName(before.exceptAll(deposits)).select("document_id").distinct()
        fresh = batch.select("record_id").unionByName(moved.select("record_id")).distinct()
        on_document = records.where("parent_id IS NOT NULL").select("record_id", F.col("parent_id").alias("document_id"))
        documents = stored(differ.unionByName(on_document.join(fresh, "record_id", "left_semi").select("document_id")).distinct(), "documents")
        touched = (
            moved.select("episode_id").unionByName(links.join(batch.select("record_id"), "record_id", "left_semi").select("episode_id"))
            .unionByName(links.join(on_document.join(documents, "document_id", "left_semi"), "record_id").select("episode_id"))
        )
        touched = stored(touched.distinct(), "touched")
        self.evaluated = touched.count()
        if self.evaluated:
            self._evaluate(records, links, deposits, touched, cursor)
        for done in (documents, touched, moved):
            discard(done)
        return self.evaluated

    def _evaluate(self, records: DataFrame, links: DataFrame, deposits: DataFrame, touched: DataFrame, cursor: str) -> None:
        known, documents = self._known(records, links, touched)
        made = stored(allocations(known, known, deposits.join(documents, "document_id", "left_semi")), "allocations")
        mine = known.where("touched")
        found = folded(mine, mine.select("record_id").count())
        rows = decided(episodes(mine), found, made, self.terms, cursor)
        rows = stored(self._reopened(rows), "verdicts")
        append_verdicts(rows, f"{self.folder}/verdicts")
        append_allocations(made.withColumn("cursor_at", F.lit(cursor)), f"{self.folder}/allocations")
        for done in (known, documents, made, rows):
            discard(done)

    def _known(self, records: DataFrame, links: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Records of the cases ``touched`` and of their documents, each once, with ``episode_id``, whether that one is ``touched``, and ``issued_on``, the day
        of their document; and those documents.

        All of it is found over ids, so that the records, which are wide, move once.
        """
        links = links.join(touched.withColumn("touched", F.lit(True)), "episode_id", "left")
        own = links.where("touched").select("record_id")
        child = records.where("parent_id IS NOT NULL").select("record_id", F.col("parent_id").alias("document_id"))
        documents = stored(child.join(own, "record_id", "left_semi").select("document_id").distinct(), "of_cases")
        of_document = child.join(documents, "document_id", "left_semi").select("record_id")
        wanted = own.unionByName(of_document).unionByName(documents.select(F.col("document_id").alias("record_id"))).distinct()
        issued = records.where("record_kind IN ('REMITTANCE', 'REBATE_BATCH')").select(F.col("record_id").alias("document_id"), F.col("event_date").alias("issued_on"))
        issued = child.join(issued, "document_id").select("record_id", "issued_on")
        placed = wanted.join(links, "record_id", "left").join(issued, "record_id", "left")
        once = F.row_number().over(Window.partitionBy("record_id").orderBy("record_id"))
        narrow = records.drop("looks_up", "trace", "source_system")  # nothing that follows reads them
        return stored(narrow.join(placed, "record_id").withColumn("_n", once).where("_n = 1").drop("_n"), "known"), documents

    def _reopened(self, rows: DataFrame) -> DataFrame:
        """What each case fell back from: by its verdict before this one, whose own flag is carried on until it is closed."""
        try:
            before = self.verdicts()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = None
        if before is None:
            return rows.withColumns({"reopened_from": F.lit(None).cast("string"), "reopened_at": F.lit(None).cast("string")})
        old = before.join(rows.select("episode_id", F.col("cursor_at").alias("now")), "episode_id").where(F.col("cursor_at") < F.col("now"))
        old = latest(old.select("episode_id", "cursor_at", "disposition", "reopened_from", "reopened_at"), ["episode_id"], ["cursor_at"])
        old = old.select("episode_id", F.col("disposition").alias("was"), F.col("reopened_from").alias("flag"), F.col("reopened_at").alias("flag_at"))
        both = rows.join(old, "episode_id", "left")
        closed = F.col("disposition") == "CLOSED"
        fell = F.coalesce((~closed & (F.col("was") == "CLOSED")) | ((F.col("was") == "PENDING") & (F.col("disposition") == "EXCEPTION")), F.lit(False))
        origin = F.when(closed, F.lit(None)).when(fell, F.col("was")).otherwise(F.col("flag"))
        at = F.when(closed, F.lit(None)).when(fell, F.col("cursor_at")).otherwise(F.col("flag_at"))
        return both.select(*rows.columns, origin.cast("string").alias("reopened_from"), at.cast("string").alias("reopened_at"))
