"""Integrity of reference tables, dimensions, counters that ride along, and numbers in words."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.sources import constraints as C
from tallyloom.sources.counters import Counters, by_reason, id_bounds
from tallyloom.sources.landing import stored


@pytest.fixture(scope="module")
def dims(spark):
    drugs = [("00011122233", "J1", 5, 10, 20, "M1"), ("00011122234", "J1", 5, 10, 20, "M1"), ("0001112223", None, 9, 9, 20, "M9"), (None, "J3", 1, None, 3, None), ("00011122233", "J4", 1, 2, 3, "M1")]
    terms = [("P", "2025-01-01", "2025-06-01"), ("P", "2025-05-31", None), ("P", "2026-01-01", "2026-02-01"), ("Q", "2025-01-01", "2025-02-01"), ("Q", "2025-02-01", "2025-03-01"), ("R", "2025-02-01", "2025-02-01")]
    return {
        "drug": spark.createDataFrame(drugs, "ndc string, j string, ceiling long, cost long, wac long, maker string"),
        "maker": spark.createDataFrame([("M1",), ("M2",)], "id string"), "term": spark.createDataFrame(terms, "payer string, since string, until string"),
    }


DECLARED = [
    C.Key("drug", ("ndc",)), C.Reference("drug", ("maker",), "maker", ("id",)), C.Check("drug", "ndc", "ndc rlike '^[0-9]{11}$'"), C.Check("drug", "costs", "ceiling < cost AND cost < wac"),
    C.Exclusive("term", ("payer",), "since", "until"), C.Rows("maker", "two or more", "true", 2), C.Rows("drug", "one J1", "j = 'J1'", 1, 1),
]


def test_seeded_breaches_are_found_and_nothing_else(dims):
    found = C.breaches(dims, DECLARED, {"drug": ("ndc",)})
    got = sorted((r["table"], r["rule"], r["row"]) for r in found.collect())
    assert got == sorted([
        ("drug", "KEY ndc", "00011122233"), ("drug", "KEY ndc", ""), ("drug", "REFERENCE maker TO maker", "M9"), ("drug", "CHECK ndc", "0001112223"), ("drug", "CHECK ndc", ""),
        ("drug", "CHECK costs", "0001112223"), ("drug", "CHECK costs", ""), ("term", "EXCLUSIVE since..until BY payer", "P|2025-05-31"), ("term", "EXCLUSIVE since..until BY payer", "P|2026-01-01"),
        ("term", "EXCLUSIVE since..until BY payer", "R|2025-02-01"), ("drug", "ROWS one J1", "2"),
    ])
    with pytest.raises(C.BrokenReference, match="KEY ndc: 2 rows"):
        C.demand(found)
    C.demand(found.limit(0))
    with pytest.raises(KeyError):
        C.breaches(dims, [C.Key("nothing", ("a",))], {})


def test_spans_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), a := rng.randrange(60), rng.choice([None, a + rng.randrange(1, 6)])) for _ in range(25)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = C.breaches({"t": df}, [C.Exclusive("t", ("k",), "s", "e")], {}).collect()
    order = sorted(rows, key=lambda r: (r[1], r[2] is None, r[2] or 0))
    late = [f"{k}|{s}" for i, (k, s, e) in enumerate(order) if any(x == k and (z is None or z > s) for x, _, z in order[:i])]
    assert sorted(r["row"] for r in got) == sorted(late)


def test_dimensions_are_broadcast_when_small_and_never_double_rows(spark, dims):
    rows = spark.createDataFrame([("00011122234", 1), ("x", 2), (None, 3)], "ndc string, n long")
    for most, broadcast in ((10, True), (2, False)):
        found = C.with_dimension(rows, dims["drug"].where("ndc = '00011122234'").unionByName(dims["drug"].where("j = 'J3'").withColumn("ndc", F.lit("7"))), "ndc", ["wac"], most if broadcast else 1)
        assert sorted((r["n"], r["wac"]) for r in found.collect()) == [(1, 20), (2, None), (3, None)]
    with pytest.raises(Exception, match="two rows of ndc"):
        C.with_dimension(rows.unionByName(rows.limit(1).withColumn("ndc", F.lit("00011122233"))), dims["drug"], "ndc", ["wac"]).collect()
    keyed = spark.createDataFrame([(1, "J1", [("HCPCS_MEDICAL", "n|J1"), ("X", "y")]), (2, "J9", [("HCPCS_MEDICAL", "n|J9"), ("X", "y")]), (3, None, None)], "n long, hcpcs string, publishes array<struct<key_type:string,key_value:string>>")
    got = C.known_codes_only(keyed, "publishes", "HCPCS_MEDICAL", "hcpcs", dims["drug"].where("j IS NOT NULL"), "j")
    assert {r["n"]: r["publishes"] and [k["key_type"] for k in r["publishes"]] for r in got.collect()} == {1: ["HCPCS_MEDICAL", "X"], 2: ["X"], 3: None}


def test_counters_ride_on_the_writing_pass(spark):
    rows = spark.range(100).withColumn("reason", F.when(F.col("id") % 10 == 0, "NO_KEY_MATCH").when(F.col("id") % 10 == 1, "NO_KEYS_PRESENT"))
    counters = Counters()
    group = f"counters-{id(rows)}"
    spark.sparkContext.setJobGroup(group, "writing")
    kept = stored(counters.watch(rows, raw_records=F.count(F.lit(1)), **by_reason()).where("id < 50"), "counted")
    stored(counters.watch(rows.limit(0), raw_records=F.count(F.lit(1)), keys=F.sum("id")), "none")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    assert counters.totals() == {"raw_records": 100, "parked_no_keys_present": 10, "parked_no_key_match": 10, "parked_ambiguous_key_match": 0, "parked_covered_entity_mismatch": 0, "keys": 0}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == len(jobs) and kept.count() == 50
    assert tuple(id_bounds(kept, "id").first()) == (0, 49) and tuple(id_bounds(kept.limit(0), "id").first()) == (None, None)


def said(n):
    """A number in words, thousands first."""
    if n < 20:
        return T.UNITS[n]
    if n < 100:
        return T.TENS[n // 10 - 2] + (f"-{T.UNITS[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{T.UNITS[n // 100]} hundred" + (f" and {said(n % 100)}" if n % 100 else "")
    name, size = next((k, v) for k, v in reversed(T.SCALES.items()) if n >= v)
    return f"{said(n // size)} {name}" + (f" {said(n % size)}" if n % size else "")


def test_numbers_in_words(spark):
    numbers = [*range(10_001), 123_456, 1_000_000, 7_300_021, 2_000_000_005]
    df = spark.createDataFrame([(n, f"It was {said(n).title() if n % 2 else said(n)} in all") for n in numbers], "n long, t string")
    assert df.where(~F.array_contains(T.numbers_in_words(F.col("t"), False), F.col("n"))).count() == 0
    one = lambda t: spark.range(1).select(T.numbers_in_words(F.lit(t))).first()[0]
    assert one("twelve hundred and five; a hundred, hundredths of a someone, two thousand\nthree") == [1205, 100, 2003]
    assert one("forty two and one") == [] and one("") == [] and one("nine hundred or nine hundred") == [900]
    assert spark.range(1).select(T.numbers_in_words(F.lit(None).cast("string"))).first()[0] is None


def test_a_larger_table_takes_more_tasks(spark):
    """Without a number of its own, a shuffle of a few small columns is merged into a few large tasks."""
    rows = spark.range(95).selectExpr("id", "id div 2 AS k", "id AS since", "id + 1 AS until")
    assert [C._dealt(rows.limit(n), ("k",), 10).rdd.getNumPartitions() for n in (0, 10, 95)] == [1, 1, 10]
    assert {r["row"] for r in C._keys(rows, C.Key("t", ("k",)), 10).collect()} == {str(k) for k in range(47)}
    assert C._spans(rows, C.Exclusive("t", ("k",), "since", "until"), 10).count() == 0
    assert C._spans(rows.withColumn("until", rows["until"] + 1), C.Exclusive("t", ("k",), "since", "until"), 10).count() == 47
