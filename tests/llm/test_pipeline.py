import collections
import hashlib
import math
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_shingle_join import shingle_set

from tallyloom.llm import mixing, packing, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs = [(i, f"A quiet letter number {i} about gardens and the weather of week {i * 7} in the valley", "en", f"src{i % 6}", 80, "x") for i in range(120)]
    docs += [(200 + i, f"you stupid idiot number {i} shut up and go away now", "en", "src0", 50, "x") for i in range(40)]
    docs += [(300 + i, docs[i][1], "en", "src1", 80, "x") for i in range(10)] + [(400, None, None, None, None, None), (401, "", "en", "src2", 0, "x")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, copy string").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 0, 1) for i in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_keep_columns_and_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "source_mixing", "best_fit_packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before
        if name == "toxicity":
            assert after == {i for i in before if not 200 <= i < 240}
        if name == "exact_dedup":
            assert after == {i for i in before if i not in range(10) and i != 400}
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert docs.columns[:3] == ["doc_id", "piece", "start"]


def plain_run(docs, chain):
    """The stages again over (doc_id, text, source) rows, as loops."""
    kept = [d for d in docs if chain.predict(toxicity.features_of(toxicity.words_of(d[1] or "")))[-1] < 0.5]
    best = {}
    for d in sorted(kept, key=lambda d: (d[0] is not None, d[0] or 0)):
        best[d[1] or ""] = d
    kept = list(best.values())
    sets = [shingle_set(d[1]) for d in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    firsts = {}
    for g, d in zip(group, kept):
        firsts[g] = min(firsts.get(g, d), d, key=lambda d: (d[0] is None, d[0] or 0))
    kept = list(firsts.values())
    pool = lambda d: d[2] if d[2] in mixing.TARGETS and d[2] != mixing.OTHER else mixing.OTHER
    sizes = {p: sum(len(d[1] or "") for d in kept if pool(d) == p) for p in mixing.TARGETS}
    weights = sum(w for p, w in mixing.TARGETS.items() if sizes[p])
    out = []
    for d in kept:
        mean = mixing.TARGETS[pool(d)] / weights * sum(sizes.values()) / sizes[pool(d)] if sizes[pool(d)] else 0.0
        assert mean <= mixing.DRAW_MEAN
        u, copies, p, below = int(hashlib.md5(f"{mixing.SEED}:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-mean), 0.0
        while below + p <= u:
            below += p
            copies += 1
            p *= mean / copies
        out += [d] * copies
    return out


def test_run_equals_a_plain_version(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chain = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = collections.Counter()
    own = Tokenizer.from_file(packing.default_vocabulary())
    for doc_id, text, _ in plain_run([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], chain):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[doc_id, 0, 0, len(ids), zlib.crc32(ids.tobytes())] += 1
    rows = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want and len(rows) > 50
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(places) == -(-sum(r["length"] for r in rows) // 2048)


def test_an_empty_table_and_repeated_ids(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    twice = docs.where("doc_id < 3").select("*", F.lit("x").alias("node"), F.lit(1).alias("salt"), F.lit(2).alias("row"))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        kept = stage(spark, twice.unionByName(twice), folder)
        assert kept.columns == twice.columns and {r["doc_id"] for r in kept.collect()} <= {0, 1, 2}
