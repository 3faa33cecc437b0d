"""What the desk asks for: projections of every kind, tolerances, queues, strengths and refusals."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.codes import MATCH_STRENGTH
from tallyloom.operators import desk


def test_projections_leave_out_what_is_absent_and_refuse_unknown_kinds(spark):
    rows = spark.createDataFrame([("BANK_TRANSACTION", "T", 0, None), ("PROVIDER_LEVEL_ADJUSTMENT", "", 5, "WO"), ("PHARMACY_REVERSAL", None, None, None)], "record_kind string, trace string, amount_cents long, reason_code string")
    got = [r["facts"] for r in desk.projected(rows).collect()]
    assert got == [{"trace": "T", "amount_cents": "0"}, {"reason_code": "WO", "amount_cents": "5"}, {}]
    assert desk.projected(rows, essential=True).first()["facts"] == {"amount_cents": "0"}
    for kind in ("OTHER", None):
        with pytest.raises(Exception, match="no projection of kind"):
            desk.projected(rows.limit(1).withColumn("record_kind", F.lit(kind).cast("string"))).collect()


def test_tolerances_are_typed_and_zero(spark):
    assert {desk.tolerance_for(k) for k in desk.TOLERANCES} == {0}
    with pytest.raises(ValueError):
        desk.tolerance_for("OTHER")
    one = lambda a, b: spark.range(1).select(desk.within("REBATE", F.lit(a).cast("long"), F.lit(b).cast("long"))).first()[0]
    assert (one(5, 5), one(5, 6), one(None, 6)) == (True, False, None)


def test_queues_and_strengths_refuse_what_they_do_not_know(spark):
    rows = spark.createDataFrame([("e1", "a", "CLOSED"), ("e1", "b", "PENDING"), ("e2", "a", "PENDING"), ("e3", "c", "PENDING")], "episode_id string, cursor_at string, disposition string")
    ids = spark.createDataFrame([("e1",), ("e9",), ("e1",)], "episode_id string")
    of = lambda *more: sorted(r["episode_id"] for r in desk.queue(rows, ["episode_id"], ["cursor_at"], *more).collect())
    assert of("PENDING", F.lit("b")) == ["e1", "e2"] and of("CLOSED", F.lit("a")) == ["e1"] and of("PENDING", None, ids) == ["e1"]
    with pytest.raises(ValueError):
        desk.queue(rows, ["episode_id"], ["cursor_at"], "OPEN")
    cash = spark.createDataFrame([("e1", b, 10) for b in MATCH_STRENGTH] + [(None, "TRN02", 1)], "episode_id string, basis string, allocated_cents long")
    assert {r["strength"]: (r["allocations"], r["cents"]) for r in desk.cash_match(cash).collect()} == {"EXACT_REFERENCE": (3, 30), "WEAK_INFERENCE": (1, 10), "UNATTRIBUTED": (1, 10)}
    with pytest.raises(Exception, match="unknown basis"):
        desk.cash_match(cash.withColumn("basis", F.lit("GUESS"))).collect()
