from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import dates as D
from tallyloom.functions import keys as K
from tallyloom.functions import money as M
from tallyloom.functions import text as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_half_away_from_zero_and_floor_division(spark):
    rows = [(n, d) for n in range(-40, 41) for d in (1, 2, 3, 7, 10)]
    got = spark.createDataFrame(rows, "n long, d long").select("n", "d", M.half_away(F.col("n"), F.col("d")).alias("h"), M.floor_div(F.col("n"), F.col("d")).alias("f")).collect()
    for r in got:
        assert r["h"] == int((Decimal(r["n"]) / r["d"]).quantize(Decimal(1), ROUND_HALF_UP)) and r["f"] == r["n"] // r["d"]


def test_money_texts(spark):
    rows = spark.createDataFrame([("12.05",), ("-0.5",), ("1.005",), ("1e3",), ("",), (None,), ("900",)], "t string")
    got = [r["c"] for r in rows.select(M.parse_cents(F.col("t")).alias("c")).collect()]
    assert got == [1205, -50, None, None, None, None, 90000]
    assert one(spark, M.cents_text(F.lit(-1205)), M.cents_text(F.lit(5)), M.cents_text(F.lit(0))) == ("-12.05", "0.05", "0.00")
    assert one(spark, M.whole_number(F.lit("0030"), 1000), M.whole_number(F.lit("3x"))) == (30000, None)


def test_amount_of_nothing_keeps_its_sign(spark, tmp_path):
    import duckdb

    from tallyloom.plans import amounts, registry

    spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 1.05), (4, 1.05), (6, None)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["amount"], r["parsed_cents"]) for r in amounts.money_text(spark, str(tmp_path)).collect()}
    assert got == {1: ("0.00", 0), 2: ("-0.00", 0), 3: ("1.05", 105), 4: ("-1.05", -105), 6: (None, None)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert {n: (a, c) for n, a, c in con.execute(registry.ORACLE_SQL["money_text"]).fetchall()} == got


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-(10**6), 10**6), st.lists(st.integers(0, 10**6), min_size=1, max_size=6)), min_size=1, max_size=20))
def test_largest_remainder_sums_exactly(spark, groups):
    from tallyloom.operators.allocation import largest_remainder

    rows = [(g, total, w, i) for g, (total, weights) in enumerate(groups) for i, w in enumerate(weights)]
    got = largest_remainder(spark.createDataFrame(rows, "g long, total long, weight long, place long"), ["g"], "total", "weight", ["place"]).collect()
    for g, (total, weights) in enumerate(groups):
        shares = {r["place"]: r["share"] for r in got if r["g"] == g}
        assert sum(shares.values()) == total
        whole = sum(weights)
        if not whole:
            assert shares[0] == total
        else:
            floors = [total * w // whole for w in weights]
            turn = sorted(range(len(weights)), key=lambda i: (-(total * weights[i] % whole), i))
            spare = total - sum(floors)
            assert [shares[i] for i in range(len(weights))] == [f + (i in turn[:spare]) for i, f in enumerate(floors)]


def test_keys_are_never_normalised_and_gaps_give_none(spark):
    got = one(
        spark, K.composite(F.lit("007"), F.lit(" a")), K.composite(F.lit(""), F.lit("a")), K.composite(F.lit("a|b"), F.lit("c")), K.composite(F.lit(None).cast("string"), F.lit("a")),
        K.claim_number(F.lit("0012FILL03FILL"))["fill"], K.claim_number(F.lit("FILL03"))["rx"], K.claim_number(F.lit("12FILL"))["rx"], K.hcpcs_of(F.lit("HC:J9035:JW")), K.hcpcs_of(F.lit("NU:1")),
    )
    assert got == ("007| a", None, None, None, "03FILL", None, None, "J9035", None)


def test_npi(spark):
    assert one(spark, *[K.valid_npi(F.lit(x)) for x in ("1234567893", "1234567890", "3234567893", "12345")], K.valid_npi(F.lit(None).cast("string"))) == (True, False, False, False, False)


def test_dates(spark):
    assert one(spark, D.iso_of_wire(F.lit("20260231")), D.iso_of_wire(F.lit("2026023")), D.wire_of_iso(F.lit("2026-02-31")), D.cursor_of(F.lit("2025-07-01").cast("date"))) == ("2026-02-31", None, "20260231", "2025-07-01T23:59:59Z")
    days = D.banking_calendar(spark, "2025-06-28", "2025-07-10", ("2025-07-04",))
    rows = spark.createDataFrame([("2025-06-28",), ("2025-07-03",), ("2025-07-01",)], "t string").select(F.to_date("t").alias("day"))
    got = {str(r["day"]): str(r["out"]) for r in D.add_banking_days(rows, "day", 1, days, "out").collect()}
    assert got == {"2025-06-28": "2025-06-30", "2025-07-03": "2025-07-07", "2025-07-01": "2025-07-02"}
    snapped = {str(r["day"]): str(r["out"]) for r in D.add_banking_days(rows, "day", 0, days, "out").collect()}
    assert snapped == {"2025-06-28": "2025-06-30", "2025-07-03": "2025-07-03", "2025-07-01": "2025-07-01"}


def test_texts(spark):
    assert one(spark, T.numbers_in(F.lit("On 2025-07-01 claim RX-0012 paid $1,200.50 of 1300"))) == (["1200.50", "1300"],)
    assert one(spark, T.quoted(F.lit("the  Quick"), F.lit("see The\nquick fox")), T.asks_to_write(F.lit("please DELETE it")), T.asks_to_write(F.lit("updated"))) == (True, True, False)
