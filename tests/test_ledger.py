"""Batches of arrivals into the ledger, against a history from scratch; and what may not be appended."""

import pytest
from pyspark.sql import functions as F
from scenario import terms
from test_scenarios import world  # noqa: F401  (a fixture)

from tallyloom.operators.asof import latest
from tallyloom.operators.episodes import history
from tallyloom.streaming.ledger import Ledger, RefusedAppend, append_allocations, append_verdicts

CURSORS = ["2025-07-05T23:59:59Z", "2025-07-10T23:59:59Z", "2025-07-15T23:59:59Z", "2025-12-31T23:59:59Z"]


@pytest.fixture(scope="module")
def ledger(spark, world, tmp_path_factory):  # noqa: F811
    records = world[0]
    book = Ledger(spark, str(tmp_path_factory.mktemp("ledger")), terms(spark))
    counts, before = [], ""
    for cursor in CURSORS:
        batch = records.where((F.col("received_at") > before) & (F.col("received_at") <= cursor))
        counts.append(book.advance(batch, cursor))
        if cursor == CURSORS[1]:
            assert book.advance(batch, cursor) == counts[-1]
        before = cursor
    return book, counts


def test_ledger_equals_a_history_from_scratch(spark, world, ledger):  # noqa: F811
    book, counts = ledger
    every = history(world[0], terms(spark), CURSORS).cache()
    watched = [c for c in every.columns if c not in ("cursor_at", "evidence")]
    for cursor in CURSORS:
        want = {r["episode_id"]: tuple(r) for r in every.where(F.col("cursor_at") == cursor).select(*watched).collect()}
        got = {r["episode_id"]: tuple(r) for r in latest(book.verdicts(), ["episode_id"], ["cursor_at"], F.lit(cursor)).select(*watched).collect()}
        assert got == want
    per_cursor = {r["cursor_at"]: r["count"] for r in book.verdicts().groupBy("cursor_at").count().collect()}
    assert [per_cursor.get(c, 0) for c in CURSORS] == counts and counts[0] == 8 and all(0 < n < 8 for n in counts[1:])
    assert book.verdicts().where("reopened_from IS NOT NULL").count() > 0


@pytest.mark.parametrize("column,value,fault", [
    ("disposition", "OPEN", "DISPOSITION"), ("reimbursement_code", "C-01", "REIMBURSEMENT_CODE"), ("rebate_code", None, "REBATE_CODE"), ("episode_id", None, "KEY"), ("reopened_from", "EXCEPTION", "REOPENED_FROM"),
])
def test_rows_outside_the_vocabulary_are_refused_as_a_whole(spark, ledger, tmp_path, column, value, fault):
    rows = ledger[0].verdicts().where(F.col("cursor_at") == CURSORS[0]).withColumn("cursor_at", F.col("cursor_at").cast("string"))
    bad = rows.withColumn(column, F.when(F.col("episode_id").endswith("C1"), F.lit(value)).otherwise(F.col(column)))
    with pytest.raises(RefusedAppend, match=fault):
        append_verdicts(bad, f"{tmp_path}/v")
    assert not (tmp_path / "v").exists()


def test_a_case_has_one_verdict_a_cursor_and_lists_keep_to_their_words(spark, ledger, tmp_path):
    rows = ledger[0].verdicts().where(F.col("cursor_at") == CURSORS[0]).withColumn("cursor_at", F.col("cursor_at").cast("string"))
    for bad, fault in ((rows.unionByName(rows.limit(1)), "UNIQUE"), (rows.withColumn("reasons", F.array(F.lit("WHY"))), "REASON"), (rows.withColumn("flags", F.array(F.lit("X-9"))), "FLAG")):
        with pytest.raises(RefusedAppend, match=fault):
            append_verdicts(bad, f"{tmp_path}/v")
    with pytest.raises(RefusedAppend, match="basis"):
        append_allocations(spark.createDataFrame([("b", "GUESS", "c")], "bank_id string, basis string, cursor_at string"), f"{tmp_path}/a")


def test_the_records_of_touched_cases_are_read_and_moved_once(spark, world, tmp_path, monkeypatch):  # noqa: F811
    """They were read as a case's own, as a document's lines and as documents, and moved for each, for being kept once, and for three joins after that."""
    from tallyloom.streaming import ledger as module

    plans = {}
    stored = module.stored
    monkeypatch.setattr(module, "stored", lambda df, name, *by: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or stored(df, name, *by))
    book = Ledger(spark, str(tmp_path / "ledger"), terms(spark))
    assert book.advance(world[0], CURSORS[-1]) == 8
    wide = [name for name, plan in plans.items() if "adjustments" in plan]
    assert wide == ["known", "verdicts"] and sum("FileScan" in line and "adjustments" in line for line in plans["known"].splitlines()) == 1
    assert sum("FileScan" in line and "adjustments" in line for line in plans["verdicts"].splitlines()) == 1 and "episode_id" in plans["known"]
