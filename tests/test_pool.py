"""The pool of waiting records, batch by batch, against one batch of everything."""

import random

import pytest
from test_crosswalk import ANCHORS, LOOKUPS, PUBLISHES, replayed

from tallyloom.streaming.pool import Pool


def world(seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(20)]
    anchors, lookups, publishes = [], [], []
    for i in range(8):
        anchors.append(("K", rng.choice(keys), f"{rng.randint(1, 60):02d}", f"E{i:02d}", rng.choice([None, None, "X", "Y"])))
    for i in range(60):
        at, entity, name = f"{rng.randint(1, 60):02d}", rng.choice([None, None, None, "X"]), f"{rng.choice('AFZ')}{i:03d}"
        lookups += [(name, at, "K", rng.choice(keys), entity) for _ in range(rng.randint(1, 2))] if rng.random() < 0.95 else [(name, at, None, None, entity)]
        if rng.random() < 0.5:
            publishes.append((name, "K", rng.choice(keys)))
    return anchors, lookups, publishes


def run(spark, folder, batches, lookups, publishes):
    pool = Pool(spark, str(folder), 4)
    seen, links = set(), {}
    for step, (names, own) in enumerate(batches):
        part = [r for r in lookups if r[0] in names], own, [r for r in publishes if r[0] in names]
        seen |= names
        everything = spark.createDataFrame([r for r in lookups if r[0] in seen], LOOKUPS), spark.createDataFrame([r for r in publishes if r[0] in seen], PUBLISHES)
        frames = [spark.createDataFrame(rows, schema) for rows, schema in zip(part, (LOOKUPS, ANCHORS, PUBLISHES))]
        for _ in range(2 if step == 1 else 1):  # a batch that is run again changes nothing
            changed = pool.advance(*frames, everything, step=step).collect()
        now = {r["record_id"]: r["episode_id"] for r in pool.attachments().collect()}
        assert {r["record_id"] for r in changed} == {n for n in now.keys() | links.keys() if now.get(n) != links.get(n)}
        links = now
    tables = [sorted(map(tuple, t.collect()), key=str) for t in (pool.attachments(), pool.parked(), pool.parks(), pool.resolutions())]
    return tables


@pytest.mark.parametrize("seed,how", [(1, "in order"), (2, "late")])
def test_any_split_into_batches_gives_the_tables_of_one_batch(spark, tmp_path, seed, how):
    anchors, lookups, publishes = world(seed)
    rng = random.Random(seed)
    arrivals = sorted({(at, t) for _, _, at, t, _ in anchors} | {(at, r) for r, at, *_ in lookups})
    if how == "late":
        rng.shuffle(arrivals)
    cuts = [0, *sorted(rng.sample(range(1, len(arrivals)), 2)), len(arrivals)]
    if how == "in order":  # one moment is in one batch
        cuts = [next((i for i in range(c, len(arrivals)) if i == 0 or arrivals[i][0] != arrivals[i - 1][0]), len(arrivals)) for c in cuts[:-1]] + [len(arrivals)]
    batches = [({n for _, n in arrivals[a:b]}, [x for x in anchors if x[3] in {n for _, n in arrivals[a:b]}]) for a, b in zip(cuts, cuts[1:])]
    many = run(spark, tmp_path / "many", batches, lookups, publishes)
    attached, parked = replayed(lookups, anchors, publishes)
    assert many[0] == sorted(((r, e, at) for r, (e, at) in attached.items()), key=str)
    assert many[1] == sorted(parked.items(), key=str)
    assert many == run(spark, tmp_path / "one", [({n for _, n in arrivals}, anchors)], lookups, publishes)
    resolved = {r[0] for r in many[3]}
    assert resolved <= {r[0] for r in many[2]} and {r[0] for r in many[2]} - resolved == set(parked)
