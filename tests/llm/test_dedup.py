import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import components, exact, simhash, substring_dedup
from tallyloom.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def reachable(ids, linked):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(("paired", "block"), [(simhash.PAIRED_LIST, simhash.BLOCK), (1, 2)])
def test_simhash_equals_all_pairs(spark, paired, block):
    base = "the quick brown fox jumps over the lazy dog and then it runs away from the very angry farmer of the town " * 4
    texts = {1: base, 2: base + "again", 3: base.upper(), 4: "", 5: None, 6: "one", 7: "One", 8: "wholly other words stand here and nothing else at all", 9: base.replace("fox", "cat"), 10: " \t\n", 11: "é ê è ü"}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(list(texts.items()), SCHEMA), paired=paired, block=block).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    least = reachable(texts, [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3])
    assert {i: r["component_id"] for i, r in got.items()} == least


@pytest.mark.parametrize(("together", "paired", "block"), [(4, 8, 1024), (4, 1, 2), (3, 7, 7), (2, 500, 500), (1, 3, 40)])
def test_links_connect_all_within_three_bits(spark, together, paired, block):
    import random

    rng = random.Random(1)
    fps = set()
    dense = rng.getrandbits(64)  # a crowd of near fingerprints, each a bit or two from another
    for _ in range(120):
        fps.add(dense := dense ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(1) << rng.randrange(64)))
    for _ in range(20):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(5):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), together, paired, block)
    got = {r["node"]: r["component"] for r in connected_components(pairs, "a", "b").collect()}
    want = reachable(signed, [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3])
    assert {f: got.get(f, f) for f in signed} == want


def test_simhash_broadcasts_nothing_that_grows(spark, monkeypatch):
    """Postings are seventy rows a fingerprint and were broadcast as long as their fingerprints' file was small, all of them to the driver."""
    plans = {}
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (simhash, components):
        monkeypatch.setattr(module, "written", lambda df, name, do=module.written: plans.update({name: plan_of(df)}) or do(df, name))
    docs = spark.createDataFrame([(i, f"word{i % 40} and others {i % 3} of a text") for i in range(200)], SCHEMA)
    found = simhash.near_duplicates(docs)
    plans["result"] = plan_of(found)
    plans["kept"] = plan_of(simhash.keep_one_of_each_group(docs))
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert connected_components(chain, "a", "b", block=8).where("component = 0").count() == 61
    assert {"postings", "edges", "within", "stars", "members", "labels"} <= plans.keys() and found.count() == 200
    assert not [name for name, plan in plans.items() if "BroadcastExchange" in plan]


def test_keep_one_of_each_group_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (2, "a b c d e", "y"), (3, "quite another text", "z")], "doc_id long, text string, row string")
    assert sorted(map(tuple, simhash.keep_one_of_each_group(docs).collect())) == [(1, "a b c d e", "x"), (3, "quite another text", "z")]
    assert simhash.keep_one_of_each_group(docs.limit(0)).count() == 0
    ids = spark.createDataFrame([(None, "a b c d e"), (None, "other words of one text"), (None, "other words of one text"), (3, "a b c d e"), (3, "a b c d e"), (3, "some third text stands here")], SCHEMA)
    kept = sorted(map(str, map(tuple, simhash.keep_one_of_each_group(ids).collect())))
    assert kept == ["(3, 'a b c d e')", "(3, 'some third text stands here')", "(None, 'other words of one text')"]
    named = ids.selectExpr("doc_id", "text", "1 AS fp", "2 AS component_id", "3 AS text_hash")
    assert simhash.keep_one_of_each_group(named).columns == named.columns and simhash.near_duplicates(named).count() == 6
    assert simhash.near_duplicates(ids.limit(0)).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_equals_brute_force(spark, weak):
    texts = {1: "a", 2: "a", 3: None, 4: "", 5: "b", 6: "é" * 5000, 7: "é" * 5000, 8: "B", None: "b"}
    key = (lambda t: F.lit(7).cast("long")) if weak else exact._text_key
    got = {r["doc_id"]: r for r in exact.exact_duplicates(spark.createDataFrame(list(texts.items()), SCHEMA), capacity=2, key_of=key).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        same = [j for j, u in texts.items() if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_with_repeated_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "b", 2)], "doc_id long, text string, key long")
    assert sorted(map(tuple, exact.drop_exact_duplicates(docs).collect())) == [(1, "a", 1), (2, "b", 2)]
    assert [(r["group_size"], r["kept"]) for r in exact.exact_duplicates(docs).where("doc_id = 1").collect()] == [(2, True)] * 2
    ids = spark.createDataFrame([(None, "a"), (None, "a"), (0, "b"), (None, "b"), (0, "c")], SCHEMA)
    assert sorted(map(str, map(tuple, exact.drop_exact_duplicates(ids).collect()))) == ["(0, 'b')", "(0, 'c')", "(None, 'a')"]
    assert exact.exact_duplicates(docs.limit(0)).count() == 0 and exact.drop_exact_duplicates(docs.limit(0)).count() == 0
    long = "w é " * 500_000
    many = spark.createDataFrame([(None, "hot")] * 300 + [(None, long), (None, long), (7, long + "x"), (8, long + "x"), (None, None), (None, "")], SCHEMA).repartition(5)
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in exact.drop_exact_duplicates(many).collect()) == [(0, 0), (0, 3), (0, len(long)), (8, len(long) + 1)]
    assert sorted({(r["keep_id"] or 0, r["group_size"]) for r in exact.exact_duplicates(many).collect()}) == [(0, 2), (0, 300), (8, 2)]


def test_exact_with_one_text_in_half_the_rows(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN repeat('same ', 200) ELSE concat('own ', id) END AS text")
    got = exact.exact_duplicates(docs, capacity=50).groupBy("keep_id", "group_size", "kept").count()
    large = sorted((r["keep_id"], r["kept"], r["count"]) for r in got.where("group_size > 1").collect())
    assert large == [(3998, False, 1999), (3998, True, 1)] and got.where("group_size = 1 AND kept").count() == 2000
    assert exact.drop_exact_duplicates(docs).count() == 2001


@pytest.mark.parametrize("bits", [0, 40, 62])
def test_directory_doubles_until_crowded_keys_are_apart(spark, bits):
    """Keys that share many leading bits need as many doublings."""
    index = spark.range(300).select(F.expr(f"shiftleft(id, {max(0, 54 - bits)}) ^ (-1L << 63)").cast("long").alias("key"))
    slots, deep = exact.directory(index, 16)
    held = index.withColumn("slot", exact._slot(F.col("key"), deep)).join(slots, "slot").groupBy("depth", "bucket").count()
    assert held.agg(F.max("count")).first()[0] <= 16 and held.agg(F.sum("count")).first()[0] == 300


def test_buckets_split_until_they_fit(spark):
    index = spark.range(5000).select(F.xxhash64("id").alias("key"))
    slots, bits = exact.directory(index, 64)
    held = index.withColumn("slot", exact._slot(F.col("key"), bits)).join(slots, "slot").groupBy("depth", "bucket").count()
    assert held.agg(F.max("count"), F.sum("count")).first()[0] <= 64 and held.agg(F.sum("count")).first()[0] == 5000


PASSAGE = "Every spring the river rises over the meadow and carries the old wooden boats away. Nobody in the village remembers a year without the flood, and the children wait for it. They stand on the bridge with long poles and count what drifts by. The oldest of them keeps a list, and in autumn he reads it aloud."


def test_repeated_passages_are_cut_but_for_the_first(spark):
    docs = {i: f"Only document {i} says so with words like w{i}a w{i}b w{i}c. {PASSAGE} And the end {i} is here with x{i} y{i} z{i}." for i in range(1, 5)}
    docs |= {10: "", 11: None, 12: "Short.", 13: "Nothing of this comes twice. It stands alone here. Nobody has copied it anywhere, as far as one can tell."}
    got = {r["doc_id"]: r for r in substring_dedup.drop_repeated_spans(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()}
    assert got[1]["text"] == docs[1] and got[13]["text"] == docs[13] and got[11]["text"] == ""
    for i in (2, 3, 4):
        assert "river rises" not in got[i]["text"] and "reads it aloud" not in got[i]["text"]
        assert f"w{i}a" in got[i]["text"] and f"z{i}" in got[i]["text"]
        cut = "".join(docs[i][s["start"] : s["end"]] for s in got[i]["removed"])
        assert len(cut) + len(got[i]["text"]) == len(docs[i])


def test_runs_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    pool = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(9)).capitalize() + "." for _ in range(12)]
    docs = [(i if i % 5 else None, " ".join(rng.choice(pool) for _ in range(8))) for i in range(40)]
    short = "The river rises over the meadow in spring. It carries the boats away again! Nobody remembers a year without it.\nChildren wait on the bridge with poles. They count what drifts by below."
    docs += [(7, "Unique words of one more row that has the number seven. Nothing in it comes twice at all. It has to stay whole, every word."), (7, short), (9, short), (9, short), (None, short), (50, ""), (50, None)]
    table = spark.createDataFrame(docs, SCHEMA)
    hashes = [r["h"] for r in table.selectExpr("xxhash64(coalesce(text, '')) AS h").collect()]
    order = sorted({(d is not None, d or 0, h, t or "") for (d, t), h in zip(docs, hashes)})
    seen, want = set(), {}
    for has_id, d, _, t in order:  # the plain way: sentence by sentence, what was seen before goes
        units = [u for line in t.split("\n") for u in re.split(r"(?<=[.!?])\s+", line) if u.strip()]
        gone = set()
        for i in range(len(units)):
            n = next((n for n in range(3, len(units) - i + 1) if len(" ".join(units[i : i + n]).split()) >= substring_dedup.RUN_WORDS), None)
            if n is None:
                break
            run = tuple(units[i : i + n])
            if run in seen:
                gone |= set(range(i, i + n))
            seen.add(run)
        want[d if has_id else None, t] = " ".join(u for k, u in enumerate(units) if k not in gone).split()
    got = substring_dedup.drop_repeated_spans(table.withColumn("removed", F.lit(1)).withColumnRenamed("text", "Text"))
    assert got.columns == ["doc_id", "Text", "removed", "n_removed_words"]
    cleaned = substring_dedup.drop_repeated_spans(table.withColumn("before", F.col("text"))).collect()
    assert len(cleaned) == len(docs)
    for r in cleaned:
        assert r["text"].split() == want[r["doc_id"], r["before"] or ""], r


def test_passage_inside_long_sentences_is_cut_after_any_prefix(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(60)]
    docs = {i: " ".join([*[word() for _ in range(20 + i)], *passage, *[word() for _ in range(30)]]) for i in range(12)}
    got = {r["doc_id"]: r for r in substring_dedup.drop_repeated_spans(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()}
    assert got[0]["text"] == docs[0]
    for i in range(1, 12):
        left = set(got[i]["text"].split())
        assert sum(w in left for w in passage) <= 20
        assert set(docs[i].split()) - set(passage) <= left


def test_runs_of_many_texts_equal_a_plain_version():
    """Units and runs sentence by sentence and word by word, as spans too, for texts of odd white space and wide full stops."""
    import random
    import re

    import xxhash

    rng = random.Random(3)
    parts = ["a", "bb", "ccc.", "d!", "e?", "。", "x。", "y！z", "？", "\n", " ", " \n ", "\t", "\u3000", "\x85", "foo", "baz", "qux.", "日本", "."]
    texts = ["", "\n", " ", "。", *(rng.choice([" ", "", " "]).join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(300))]

    def plain(text):
        at, out = 0, []
        for stop, after in [*((m.start(), m.end()) for m in re.finditer(r"(?<=[.!?])\s+|\n\s*|(?<=[。！？])", text)), (len(text), len(text))]:
            words = [(at + m.start(), at + m.end(), m[0]) for m in re.finditer(r"\S+", text[at:stop])]
            hashes = [xxhash.xxh3_64_intdigest(w.encode()) for _, _, w in words]
            if len(words) > substring_dedup.SENTENCE_WORDS:
                first = 0
                for k in range(len(words)):
                    if k == len(words) - 1 or hashes[k] == min(hashes[max(0, k - 2) : k + 3]):
                        out.append((words[first][0], words[k][1], tuple(w for _, _, w in words[first : k + 1])))
                        first = k + 1
            elif words:
                out.append((at, stop, tuple(w for _, _, w in words)))
            at = after
        return out

    def ends(units):
        for i in range(len(units)):
            n = next((n for n in range(3, len(units) - i + 1) if sum(len(u[2]) for u in units[i : i + n]) >= substring_dedup.RUN_WORDS), None)
            if n:
                yield i, i + n

    units = [plain(t) for t in texts]
    want = [(k, i, tuple(u[2] for u in own[i:j])) for k, own in enumerate(units) for i, j in ends(own)]
    text, place, halves = substring_dedup.runs(texts, substring_dedup._Words())
    assert list(zip(text.tolist(), place.tolist())) == [w[:2] for w in want]
    hashes = list(map(tuple, halves.tolist()))
    assert len(set(hashes)) == len({w[2] for w in want}) == len({(h, w[2]) for h, w in zip(hashes, want)})
    places = [np.array([i for i, _ in ends(own) if rng.random() < 0.2], np.int32) for own in units]
    for t, own, p, (left, spans, n) in zip(texts, units, places, substring_dedup.cuts(texts, places, substring_dedup._Words())):
        gone = sorted({k for i, j in ends(own) if i in p for k in range(i, j)})
        assert n == sum(len(own[k][2]) for k in gone)
        assert [s["start"] for s in spans] == [own[k][0] for k in gone if k - 1 not in gone] and [s["end"] for s in spans] == [own[k][1] for k in gone if k + 1 not in gone]
        assert len(left) == len(t) - sum(s["end"] - s["start"] for s in spans)


def test_components_spend_no_round_on_stars(spark, monkeypatch):
    """Known components with nothing to join take no round, and a last one only to see that nothing changes is not made."""
    rounds = []
    written = components.written
    monkeypatch.setattr(components, "written", lambda df, name: rounds.append(name) or written(df, name))
    stars = [(i, i % 3) for i in range(3, 30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(stars, "a long, b long"), "a", "b").collect()}
    assert got == {i: i % 3 for i in range(30)} and rounds == ["edges"]
    rounds.clear()
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*stars, (4, 5)], "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 if i % 3 == 0 else 1 for i in range(30)} and rounds.count("stars") <= 2


def test_components_of_one_block_take_no_round(spark, monkeypatch):
    """A long path took a round for every doubling, each with several shuffles to be planned; blocks of edges are stars before that."""
    rounds = []
    written = components.written
    monkeypatch.setattr(components, "written", lambda df, name: rounds.append(name) or written(df, name))
    path = [(i * 37 % 211, (i + 1) * 37 % 211) for i in range(150)]
    links = [*path, (7, 7), *path[:9], (1000, -3), (-3, 1001)]
    want = reachable({n for e in links for n in e}, links)
    table = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(table, "a", "b").collect()} == want and rounds == ["edges"]
    rounds.clear()
    got = [(r["node"], r["component"]) for r in connected_components(table, "a", "b", block=20).collect()]
    assert len(got) == len(want) and dict(got) == want and rounds[:2] == ["edges", "within"] and "stars" in rounds
    assert connected_components(table.limit(0), "a", "b").count() == 0 == connected_components(spark.createDataFrame([(7, 7)], "a long, b long"), "a", "b").count()


def test_a_task_makes_stars_of_blocks():
    """A task holds a block or two, however many edges it gets, and loses no connection."""
    rng = np.random.default_rng(5)
    for many, block in ((1, 1), (300, 8), (300, 1000)):
        a, b = rng.integers(-200, 200, (2, many))
        nodes, least = components._stars_of(a, b)
        assert dict(zip(nodes.tolist(), least.tolist())) == reachable({*a.tolist(), *b.tolist()}, list(zip(a.tolist(), b.tolist())))
