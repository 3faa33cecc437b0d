"""The near-duplicate stage of the pipeline against all pairs of five-word shingle sets."""

import random

import corpus_pipeline
from test_dedup import SCHEMA, reachable

from tallyloom.llm import components, exact, shingle_join, simhash


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def copies():
    """Ten texts with near copies at about 0.8 to 0.95, a crowd around one text, and texts that share a passage only."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = {}
    for _ in range(10):
        base = [word() for _ in range(rng.randint(60, 300))]
        texts[len(texts)] = " ".join(base)
        for share in (0.95, 0.9, 0.85, 0.81, 0.79, 0.7):
            cut = max(1, round(len(base) * (1 - share) / (1 + share)))
            texts[len(texts)] = " ".join([*base[:-cut], *[word() for _ in range(cut)]])
            apart = list(base)
            for at in range(3, len(base) - 5, max(10, round(10 / (1 - share)))):
                apart[at] = word()
            texts[len(texts)] = " ".join(apart).upper()
    crowd = [word() for _ in range(80)]
    passage = [word() for _ in range(40)]
    for _ in range(90):
        near = list(crowd)
        for _ in range(rng.randint(0, 2)):
            near[rng.randrange(80)] = word()
        texts[len(texts)] = " ".join(near)
        texts[len(texts)] = " ".join([*passage, *[word() for _ in range(rng.randint(1, 40))]])
    return texts | {1000: "", 1001: None, 1002: "one two", 1003: "One  two", 1004: "one two three four five"}


def test_components_equal_all_pairs(spark):
    texts = copies()
    sets = {i: shingle_set(t) for i, t in texts.items()}
    similar = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.near_duplicates(docs).collect()}
    assert got == reachable(texts, similar)


def test_stage_drops_near_copies_at_four_fifths(spark):
    texts = copies()
    sets = {i: shingle_set(t) for i, t in texts.items()}
    similar = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, row string")
    kept = corpus_pipeline.drop_near(spark, docs, "")
    assert kept.columns == docs.columns
    least = reachable(texts, similar)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in texts if least[i] == i}
    assert corpus_pipeline.drop_near(spark, docs.limit(0), "").count() == 0
    ids = spark.createDataFrame([(None, "a b c d e f"), (None, "other words of one text here"), (None, "other words of one text here"), (3, "a b c d e f"), (3, "some third text stands here now")], SCHEMA)
    kept = sorted(map(str, map(tuple, corpus_pipeline.drop_near(spark, ids, "").collect())))
    assert kept == ["(3, 'a b c d e f')", "(3, 'some third text stands here now')", "(None, 'other words of one text here')"]


def test_only_hashes_are_ever_broadcast(spark, monkeypatch):
    """What was joined was broadcast where its file, or that of what it was exploded from, was small; of the tables that grow only bare hashes may be, as their files do not compress."""
    plans = []
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (shingle_join, simhash, components, exact):
        monkeypatch.setattr(module, "written", lambda df, name, do=module.written: plans.append((name, plan_of(df))) or do(df, name))
    docs = spark.createDataFrame([(i, t, "x") for i, t in copies().items()], "doc_id long, text string, row string")
    kept = exact.drop_exact_duplicates(docs)
    plans.append(("exact_dedup", plan_of(kept)))
    plans.append(("near_dedup", plan_of(shingle_join.keep_one_of_each_group(kept))))
    assert {"postings", "live", "merged", "lists", "compared", "whole", "similar", "parts", "edges", "members"} <= {name for name, _ in plans}
    # Directories, which have a slot for thousands of texts, and hashes of nodes and wanted texts.
    assert {name for name, plan in plans if "BroadcastExchange" in plan} <= {"directory", "index", "bitmaps", "whole"}


def test_simhash_comes_first(spark, monkeypatch):
    """The stage's first candidates are what fingerprints within three bits connect; its result stays that of all pairs."""
    texts = copies()
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    sets = shingle_join.set_table(docs)
    nodes = {r["doc_id"]: (r["node"], r["fp"]) for r in sets.collect()}
    fps = {i: simhash.fingerprint_of(t) for i, t in texts.items()}
    assert {i: fp % (1 << 64) for i, (_, fp) in nodes.items()} == fps
    near = [(nodes[a][0], nodes[b][0]) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    named = {n: "" for n, _ in nodes.values()}
    got = [(r["a"], r["b"]) for r in shingle_join._by_fingerprint(sets).collect()]
    assert reachable(named, got) == reachable(named, near) and any(a != b for a, b in got)
    asked = []
    similar = shingle_join._similar
    monkeypatch.setattr(shingle_join, "_similar", lambda *a: asked.append([(r["a"], r["b"]) for r in a[2].collect()]) or similar(*a))
    shingle_join.components(docs, sets).collect()
    assert reachable(named, asked[0]) == reachable(named, near)
