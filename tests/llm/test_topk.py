import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import topk as T

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, every=100, k=10):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in fine:
        if qi is None or qi % every:
            continue
        scored = [(-max(-T.MOST, min(T.MOST, sum(a * b for a, b in zip(q, c)))), ci is None, ci or 0, ci) for ci, c in fine if ci != qi]
        out += [(qi, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


def test_given_embeddings_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert found(T.search_embeddings(df)) == brute([tuple(r) for r in df.select("vec_id", "embedding").collect()])


@pytest.mark.parametrize("k,bits,c_rows,q_rows", [(3, 2, 7, 4), (10, 4, 50, 3), (1, 11, 1000, 1000), (400, 3, 20, 50)])
def test_any_split_into_blocks_and_bins_equals_brute_force(spark, k, bits, c_rows, q_rows):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) * (1 + i % 3) for _ in range(3)]) for i in range(150)]
    rows += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(100)] + [(20, [0.5, 0.0, 0.0]), (None, [3.0, 3.0, 3.0]), (None, [3.0, 3.0, 3.0])]
    df = spark.createDataFrame([(i, [float(math.floor(1024 * x)) for x in v]) for i, v in rows], "id long, v array<double>")
    got = found(T.top_k(df.where("id % 10 = 0"), df, k, bits, c_rows, q_rows))
    assert got == brute(rows, 10, k)


def test_rows_that_take_no_part_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0]), (100, [0.5]), (200, []), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [-inf, 1.0]), (5, [0.0005, -0.0005])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("V", F.lit(1)).withColumn("block", F.lit(2))
    padded = [(i, v if v is None or any(x is None for x in v) else v + [0.0] * (2 - len(v))) for i, v in rows]
    assert found(T.search_embeddings(df)) == brute(padded)
    assert T.search_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
    assert T.search_embeddings(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0
    assert T.search_embeddings(spark.createDataFrame([(100, [1.0])], SCHEMA)).count() == 0


def test_large_entries_are_exact_or_saturate(spark):
    rows = [(0, [3e6, 1.0]), (1, [2e6, 1 / 1024]), (2, [2e6, 0.0]), (3, [1e200, 0.0]), (4, [-1e200, 5.0]), (100, [1e200, 1.0])]
    assert found(T.search_embeddings(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    q = np.array([[2.0**50, 1.0]])
    assert T.exact_products(q, np.array([[4.0, 1.0], [0.0, 2.0**51]])).tolist() == [[2**52 + 1, 2**51]]
