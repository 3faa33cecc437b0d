"""The crosswalk in event time against a plain replay of the records in the order of their arrival."""

import random

import pytest

from tallyloom.operators.crosswalk import attach

LOOKUPS = "record_id string, at string, key_type string, key_value string, entity string"
ANCHORS = "key_type string, key_value string, first_seen_at string, target string, target_entity string"
PUBLISHES = "record_id string, key_type string, key_value string"


def replayed(lookups, anchors, publishes):
    """Every record in order, and after each one the whole pool of parked ones until nothing changes."""
    entity_of = {t: e for _, _, _, t, e in anchors}
    events = sorted({(at, t, "episode") for _, _, at, t, _ in anchors} | {(at, r, "record") for r, at, *_ in lookups})
    keys = {}
    for r, _, _, v, _ in lookups:
        keys.setdefault(r, set()).update([v] if v is not None else [])
    entity = {r: e for r, _, _, _, e in lookups}
    known, attached, parked = {}, {}, {}

    def judge(r, at):
        targets = {t for v in keys[r] for t in known.get(v, ())}
        if not keys[r]:
            return "NO_KEYS_PRESENT"
        if not targets:
            return "NO_KEY_MATCH"
        if len(targets) > 1:
            return "AMBIGUOUS_KEY_MATCH"
        target = targets.pop()
        if None not in (entity[r], entity_of[target]) and entity[r] != entity_of[target]:
            return "COVERED_ENTITY_MISMATCH"
        attached[r] = target, at
        for q, _, v in publishes:
            if q == r:
                known.setdefault(v, set()).add(target)
        return None

    for at, who, kind in events:
        if kind == "episode":
            for _, v, _, t, _ in anchors:
                if t == who:
                    known.setdefault(v, set()).add(t)
        else:
            parked[who] = judge(who, at)
        again = True
        while again:
            again = False
            for r in [r for r, why in parked.items() if why == "NO_KEY_MATCH"]:
                parked[r] = judge(r, at)
                again |= parked[r] is None
    return attached, {r: why for r, why in parked.items() if why}


def found(spark, lookups, anchors, publishes):
    one, other = attach(spark.createDataFrame(lookups, LOOKUPS), spark.createDataFrame(anchors, ANCHORS), spark.createDataFrame(publishes, PUBLISHES))
    return {r["record_id"]: (r["episode_id"], r["attached_at"]) for r in one.collect()}, {r["record_id"]: r["reason"] for r in other.collect()}


def test_a_record_with_two_targets_at_its_arrival_parks(spark):
    """What was known later by a longer way still counts: judged by rounds, R would attach to E1."""
    anchors = [("K", "k1", "01", "E1", None), ("K", "k0", "02", "E2", None)]
    lookups = [("R", "10", "K", "k1", None), ("R", "10", "K", "k2", None), ("S", "03", "K", "k0", None)]
    assert found(spark, lookups, anchors, [("S", "K", "k2")]) == ({"S": ("E2", "03")}, {"R": "AMBIGUOUS_KEY_MATCH"})


def test_a_blocked_carrier_makes_nothing_known(spark):
    """B would publish k3, but it is torn; so the record that waits for k3 attaches later and elsewhere."""
    anchors = [("K", "k1", "01", "E1", None), ("K", "k2", "02", "E2", None), ("K", "k3", "20", "E3", None)]
    lookups = [("B", "05", "K", "k1", None), ("B", "05", "K", "k2", None), ("R", "10", "K", "k3", None)]
    assert found(spark, lookups, anchors, [("B", "K", "k3"), ("R", "K", "k9")]) == ({"R": ("E3", "20")}, {"B": "AMBIGUOUS_KEY_MATCH"})


def test_records_that_only_know_each_other_stay_parked(spark):
    anchors = [("K", "x", "01", "E1", None)]
    lookups = [("a", "02", "K", "p", None), ("b", "03", "K", "q", None), ("c", "04", "K", "c", None), ("d", "05", None, None, None)]
    publishes = [("a", "K", "q"), ("b", "K", "p"), ("c", "K", "c")]
    assert found(spark, lookups, anchors, publishes) == ({}, {"a": "NO_KEY_MATCH", "b": "NO_KEY_MATCH", "c": "NO_KEY_MATCH", "d": "NO_KEYS_PRESENT"})


def test_chains_of_any_length_and_early_records(spark):
    n = 7
    lookups = [(f"r{i}", f"{90 - i}", "K", f"v{i}", None) for i in range(1, n + 1)]
    publishes = [(f"r{i}", "K", f"v{i + 1}") for i in range(1, n + 1)]
    assert found(spark, lookups, [("K", "v1", "95", "E", None)], publishes) == ({f"r{i}": ("E", "95") for i in range(1, n + 1)}, {})


@pytest.mark.parametrize("seed", range(4))
def test_random_records_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(rng.choice([8, 25, 60]))]
    stamp = lambda: f"{rng.randint(1, 60):02d}"
    anchors, lookups, publishes = [], [], []
    for i in range(12):
        at, entity = stamp(), rng.choice([None, None, "X", "Y"])
        anchors += [("K", rng.choice(keys), at, f"E{i:02d}", entity) for _ in range(rng.randint(1, 2))]
    for i in range(120):
        at, entity, name = stamp(), rng.choice([None, None, None, "X", "Y"]), f"{rng.choice('ABFZ')}{i:03d}"
        lookups += [(name, at, "K", rng.choice(keys), entity) for _ in range(rng.randint(1, 3))] if rng.random() < 0.95 else [(name, at, None, None, entity)]
        if rng.random() < 0.5:
            publishes += [(name, "K", rng.choice(keys)) for _ in range(rng.randint(1, 2))]
    assert found(spark, lookups, anchors, publishes) == replayed(lookups, anchors, publishes)


def test_a_key_is_kept_once_a_target_and_only_if_it_is_asked_for(spark):
    """Rows that repeat each other, or that nobody looks up, would be ranked, written and joined in every round."""
    from tallyloom.operators import crosswalk as X

    rows = [("K", f"k{k}", f"{t:02d}", f"E{t}", None) for k in range(3) for t in range(5)]
    anchors = X.anchor_keys(spark.createDataFrame(rows, ANCHORS))
    lookups = spark.createDataFrame([("R", "50", "K", "k1", None)], LOOKUPS)
    asked = X._asked(anchors, lookups)
    assert {r["key_value"] for r in asked.collect()} == {"k1"}
    for suspects in (False, True):
        known = X._best(asked, suspects).collect()
        assert [(r["target"], r["suspect"]) for r in sorted(known, key=lambda r: r["target"])] == [("E0", False), ("E1", False)]
