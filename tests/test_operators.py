import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import allocation, asof, folds, matching, reads
from tallyloom.sources.contracts import Contracts, Field, governed_breaches
from tallyloom.sources.controls import declared, demand_agreement, reconciled
from tallyloom.sources.landing import append_once, checked, landed, new_rows, upserted


def test_reopened_flag_equals_a_plain_fold(spark):
    rng = random.Random(5)
    rows = [(k, t, rng.choice(["CLOSED", "PENDING", "EXCEPTION", None])) for k in range(60) for t in range(12)]
    got = {(r["k"], r["t"]): (r["reopened_from"], r["reopened_at"]) for r in asof.carry_reopened(spark.createDataFrame(rows, "k long, t long, disposition string"), ["k"], ["t"], "disposition", "t").collect()}
    for k in range(60):
        was, flag = None, (None, None)
        for _, t, now in [r for r in rows if r[0] == k]:
            if (now is not None and was == "CLOSED" and now != "CLOSED") or (was == "PENDING" and now == "EXCEPTION"):
                flag = (was, t)
            elif now == "CLOSED":
                flag = (None, None)
            assert got[k, t] == flag
            was = now


def test_latest_and_first_keep_whole_rows_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b"), (2, 1, "b")], "k int, t int, v string")
    assert sorted(map(tuple, asof.latest(rows, ["k"], ["t"]).collect())) == [(1, 2, None), (2, 1, "b")]
    assert sorted(map(tuple, asof.first_delivery(rows, ["k"], ["t"]).collect())) == [(1, 1, "a"), (2, 1, "b")]
    assert asof.latest(rows, ["k"], ["t"], F.lit(1)).where("k = 1").first()["v"] == "a"
    assert asof.latest(rows.limit(0), ["k"], ["t"]).count() == 0


def test_dense_ids(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = sorted((r["x"], r["number"]) for r in asof.dense_ids(rows, ["x"]).collect())
    assert got == [(i, i + 1) for i in range(1000)]


def test_decisions_in_order(spark):
    published = spark.createDataFrame([("K", "a", 1, "e1", "X"), ("K", "b", 1, "e1", "X"), ("K", "c", 1, "e2", None), ("K", "d", 9, "e3", None)], "key_type string, key_value string, first_seen_at int, target string, target_entity string")
    lookups = [("one", 5, "K", "a", "X"), ("one", 5, "K", "b", "X"), ("two", 5, "K", "a", None), ("two", 5, "K", "c", None), ("late", 5, "K", "d", None), ("none", 5, None, None, None), ("clash", 5, "K", "a", "Y"), ("miss", 5, "K", "zz", None)]
    got = {r["record_id"]: (r["decision"], r["target"]) for r in matching.resolve(spark.createDataFrame(lookups, "record_id string, at int, key_type string, key_value string, entity string"), published).collect()}
    assert got == {"one": ("ATTACHED", "e1"), "two": ("AMBIGUOUS_KEY_MATCH", None), "late": ("NO_KEY_MATCH", None), "none": ("NO_KEYS_PRESENT", None), "clash": ("COVERED_ENTITY_MISMATCH", None), "miss": ("NO_KEY_MATCH", None)}


def test_targets_of_keys_equal_all_pairs_and_none_are_made(spark):
    rng = random.Random(5)
    keys, entity = [f"k{i}" for i in range(6)], lambda: rng.choice([None, None, "X", "Y"])
    published = [("A", rng.choice(keys), rng.randint(1, 9), f"e{rng.randint(1, 5)}", entity()) for _ in range(14)]
    lookups = []
    for i in range(150):
        at, own = rng.randint(0, 10), entity()
        lookups += [(f"r{i:03d}", at, "A", rng.choice([*keys, "none"]), own) for _ in range(rng.choice([1, 1, 2, 3]))] if i % 10 else [(f"r{i:03d}", at, None, None, own)]
    a = spark.createDataFrame(lookups, "record_id string, at int, key_type string, key_value string, entity string")
    b = spark.createDataFrame(published, "key_type string, key_value string, first_seen_at int, target string, target_entity string")
    got = {r["record_id"]: tuple(r)[1:] for r in matching.resolve(a, b).collect()}
    for name in {r[0] for r in lookups}:
        own = [r for r in lookups if r[0] == name]
        hits = [(t, e, r[4]) for r in own for _, v, since, t, e in published if v == r[3] and since <= r[1]]
        apart, clash = {t for t, _, _ in hits}, any(e and mine and e != mine for _, e, mine in hits)
        why = "NO_KEYS_PRESENT" if own[0][3] is None else "NO_KEY_MATCH" if not apart else "AMBIGUOUS_KEY_MATCH" if len(apart) > 1 else "COVERED_ENTITY_MISMATCH" if clash else "ATTACHED"
        assert got[name] == (len(apart), apart.pop() if why == "ATTACHED" else None, why)
    hot = spark.range(20_000).selectExpr("id AS record_id", "id AS at", "'A' AS key_type", "'one' AS key_value", "CAST(NULL AS STRING) AS entity")
    many = hot.selectExpr("key_type", "key_value", "at AS first_seen_at", "record_id AS target", "entity AS target_entity")
    assert matching.resolve(hot, many).agg(F.sum("targets")).first()[0] == 20_000 * 20_001 // 2


def test_band_match_equals_all_pairs(spark):
    rng = random.Random(3)
    day = lambda: f"2025-07-{rng.randint(1, 28):02d}"
    left = [(f"l{i}", rng.randint(1, 4), day()) for i in range(60)]
    right = [(f"r{i}", rng.randint(1, 4), day()) for i in range(30)]
    a = spark.createDataFrame(left, "l string, amount int, d string").withColumn("d", F.to_date("d"))
    b = spark.createDataFrame(right, "r string, amount int, d string").withColumn("d", F.to_date("d"))
    got = {r["l"]: (r["candidates"], r["match"]) for r in matching.band_match(a, b, ["amount"], "d", "d", "l", "r", 3).collect()}
    for name, amount, d in left:
        near = [r for r, x, e in right if x == amount and abs(int(d[-2:]) - int(e[-2:])) <= 3]
        assert got.get(name, (0, None)) == (len(near), near[0] if len(near) == 1 else None)


@pytest.mark.parametrize(
    "deposit, lines, plb, want",
    [(150, [90, 90], [30], [90, 90, -30]), (100, [90, 90], [], [50, 50]), (100, [50, 25, 26], [], [49, 25, 26]), (70, [0, 0], [], [0, 0, 70]), (-10, [], [10], [-10])],
)
def test_plan(spark, deposit, lines, plb, want):
    children = [("doc", f"c{i}", "LINE", a, f"e{i}") for i, a in enumerate(lines)] + [("doc", f"p{i}", "PLB", a, "e0") for i, a in enumerate(plb)]
    got = allocation.plan(
        spark.createDataFrame([("b", "doc", deposit, "TRN02")], "bank_id string, document_id string, deposit_cents long, basis string"),
        spark.createDataFrame(children, "document_id string, child_id string, kind string, amount_cents long, episode_id string"),
    ).orderBy(F.col("child_id").isNull(), "child_id").collect()
    assert [r["allocated_cents"] for r in got] == want and sum(want) == deposit


def test_deltas_and_first_basis(spark):
    schema = "bank_id string, basis string, child_id string, allocated_cents long"
    old = spark.createDataFrame([("b", "RESIDUAL", "a", 10), ("b", None, "c", 5)], schema)
    new = spark.createDataFrame([("b", "TRN02", "a", 10), ("b", None, "c", 5)], schema)
    assert sorted((r["basis"], r["delta_cents"]) for r in allocation.deltas(old, new, ["bank_id", "basis"]).collect()) == [("RESIDUAL", -10), ("TRN02", 10)]
    assert allocation.first_basis(old.where("basis IS NOT NULL")).first()["basis"] == "TRN02"


def test_one_amount_counts_a_missing_one(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, None), (3, 5), (4, None), (4, None)], "k int, a int")
    assert {r["k"]: r["d"] for r in rows.groupBy("k").agg(folds.one_amount("a").alias("d")).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_contracts(spark):
    known = Contracts()
    known.register("v", "1", [Field("npi", "NPI"), Field("amount", "MONEY", required=False)])
    rows = spark.createDataFrame([("1234567893", "1.5"), ("12", None), (None, "x")], "npi string, amount string")
    good, bad = known.split(rows, "v", "1")
    assert good.count() == 1 and sorted(r["violations"] for r in bad.collect()) == [["npi: NPI"], ["npi: missing", "amount: MONEY"]]
    assert known.split(rows, "v", "2")[0].count() == 0 and known.split(rows, "other", "1")[0].count() == 3
    with pytest.raises(ValueError):
        known.register("v", "1", [])
    stated = rows.select(governed_breaches("npi", {"amount": ("12",)}).alias("b")).collect()
    assert [r["b"] for r in stated] == [["amount"], [], ["amount"]]


def test_control_totals(spark):
    rows = spark.createDataFrame([("f", 1, "DETAIL", None), ("f", 2, "TRAILER", "3"), ("f", 3, "TRAILER", "1"), ("g", 1, "TRAILER", "many"), ("h", 1, "DETAIL", None)], "file string, line_no int, record_type string, record_count string")
    stated = declared(rows, "file")
    assert {r["file"]: (r["has_trailer"], r["declared_count"]) for r in stated.collect()} == {"f": (True, 1), "g": (True, None), "h": (False, None)}
    counted = rows.where("record_type = 'DETAIL'").groupBy("file").agg(F.count("*").alias("observed_count"))
    totals = reconciled(counted, stated.where("has_trailer"), "file")
    assert {r["file"]: r["agrees"] for r in totals.collect()} == {"f": True, "g": True, "h": False}
    with pytest.raises(ValueError):
        demand_agreement(totals)


def test_sinks_append_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "id int, payload string")
    assert append_once(rows, f"{tmp_path}/t", ["id"]) == 2
    assert append_once(rows, f"{tmp_path}/t", ["id"]) == 0
    assert new_rows(rows, rows, ["id"]).count() == 0
    assert upserted(rows.selectExpr("id", "payload", "1 AS v"), spark.createDataFrame([(1, "z", 2)], "id int, payload string, v int"), ["id"], "v").where("id = 1").first()["payload"] == "z"
    assert landed(rows).count() == 3
    with pytest.raises(Exception, match="bad id"):
        checked(rows, F.col("id").isNotNull(), "bad id").collect()


def test_queue_refuses_unknown_orders_and_limits(spark):
    rows = spark.createDataFrame([("e1", 3, -50, None), ("e2", 9, 10, "CLOSED")], "episode_id string, age_days int, variance_cents long, reopened_from string")
    assert [r["episode_id"] for r in reads.queue(rows, "variance_desc").collect()] == ["e1", "e2"]
    assert [r["episode_id"] for r in reads.queue(rows, "reopened_first").collect()] == ["e2", "e1"]
    for bad in ({"order": "x"}, {"order": "age_asc", "limit": 0}, {"order": "age_asc", "limit": 1001}):
        with pytest.raises(ValueError):
            reads.queue(rows, **bad)


def test_collapsed_duplicates_and_merged_decisions(spark):
    raw = spark.createDataFrame([("r1", "s", "a"), ("r2", "s", "a"), ("r3", "s", "b")], "raw_id string, source_system string, source_record_id string")
    assert [r["raw_id"] for r in matching.collapsed_duplicates(raw, spark.createDataFrame([("r1",)], "raw_id string")).collect()] == ["r2"]
    a = spark.createDataFrame([("k", 1, "OK"), ("k", 2, "BAD")], "id string, n int, outcome string")
    b = spark.createDataFrame([("m", 1, "PAID")], "id string, n int, state string")
    assert sorted(map(tuple, folds.merged_decisions(a, b, "id", ["n"], (["outcome"], ["state"])).collect())) == [("k", "BAD", None), ("m", None, "PAID")]


def test_quotes_equal_brute_force(spark):
    from tallyloom.operators import quotes

    texts = {1: "The  quick brown\nfox jumps over the lazy dog", 2: "a quick brown fox", 3: None, 4: "", 5: "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOGS again and again", 6: "one two three"}
    said = {10: "quick brown fox", 11: "ick brown fox jumps over the lazy do", 12: "one two three", 13: "two", 14: None, 15: "fox jumps over a lazy dog", 16: "the quick brown fox jumps over the lazy dog"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame(list(said.items()), "item_id long, quote string")
    plain = lambda t: " ".join((t or "").lower().split())
    want = {(d, q) for d, t in texts.items() for q, u in said.items() if len(plain(u).split()) >= 3 and plain(u) in plain(t)}
    assert {tuple(r) for r in quotes.quoted_in(docs, asked, "doc_id", "item_id").collect()} == want and len(want) == 8


def test_raw_ids_are_the_same_in_every_read(spark, tmp_path):
    from tallyloom.sources import feeds

    lines = ['{"record_id": "1"}', '{"record_id": "2"}', '{"record_id": "1"}', ""]
    for name in ("a.jsonl", "b.jsonl"):
        (tmp_path / name).write_text("\n".join(lines))
    source = lambda *names: feeds.Source("s", "PBM", "JSONL", tuple(str(tmp_path / n) for n in names))
    ids = lambda *names: sorted(r["raw_id"] for r in feeds.read_jsonl(spark, source(*names), "2025-01-01").select("raw_id").collect())
    assert ids("a.jsonl", "b.jsonl") == ids("a.jsonl") == ids("b.jsonl") and len(set(ids("a.jsonl"))) == 3


def test_more_records_take_more_tasks_and_answers_are_told_apart(spark):
    from tallyloom.operators.episodes import evidence
    from tallyloom.operators.normalize import RECORD

    lines = [{"record_id": f"r{i}", "record_kind": "REMITTANCE_CLAIM_LINE", "icn": ("a", "b", "a", None)[i % 4], "amount_cents": 1, "charge_cents": 1, "received_at": "2025"} for i in range(40)]
    records = spark.createDataFrame([tuple(r.get(n) for n in RECORD) for r in lines], ", ".join(f"{n} {t}" for n, t in RECORD.items()))
    links = spark.createDataFrame([(f"r{i}", f"e{i // 4}") for i in range(40)], "record_id string, episode_id string")
    found = evidence(records, links, 5)
    assert found.rdd.getNumPartitions() == 8
    assert {(r["episode_id"], r["lines"], r["answers"], len(r["evidence"])) for r in found.collect()} == {(f"e{i}", 4, 2, 4) for i in range(10)}
