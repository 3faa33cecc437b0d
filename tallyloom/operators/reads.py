"""Reads that a user of the engine asks for: queues, overviews, spreads, timelines, one case in full."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS = 1000


def orderings(key: str, age: str, variance: str, state: str, ranks: dict[str, int]) -> dict[str, list[Column]]:
    """The closed list of orders of a queue; every one ends with the key, so no two rows tie."""
    rank = F.lit(len(ranks))
    for value, place in ranks.items():
        rank = F.when(F.col(state) == value, place).otherwise(rank)
    return {
        "age_desc": [F.desc(age), F.asc(key)],
        "age_asc": [F.asc(age), F.asc(key)],
        "variance_desc": [F.abs(F.col(variance)).desc(), F.asc(key)],
        "reopened_first": [rank.asc(), F.asc(key)],
        "episode_id": [F.asc(key)],
    }


def queue(df: DataFrame, order: str, key: str = "episode_id", age: str = "age_days", variance: str = "variance_cents", state: str = "reopened_from", ranks: dict[str, int] | None = None, limit: int = 100) -> DataFrame:
    """The first ``limit`` rows (1 to 1000) of a queue in a named order; an unknown name is refused."""
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"a limit lies between 1 and {MOST_ROWS}")
    known = orderings(key, age, variance, state, {"CLOSED": 0, "PENDING": 1} if ranks is None else ranks)
    if order not in known:
        raise ValueError(f"unknown order {order!r}; known: {', '.join(known)}")
    return df.orderBy(*known[order]).limit(limit)


def overview(df: DataFrame, by: str, values: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures by one of a few known values; a value without rows has zeros."""
    spark = df.sparkSession
    found = df.groupBy(by).agg(*[m.alias(n) for n, m in measures.items()])
    named = F.broadcast(spark.createDataFrame([(v,) for v in values], f"{by} string"))
    return named.join(found, by, "left").select(by, *[F.coalesce(n, F.lit(0).cast("long")).cast("long").alias(n) for n in measures])


def pair_spread(df: DataFrame, pair: list[str], out: str = "episodes", limit: int = 25) -> DataFrame:
    return df.groupBy(*pair).agg(F.count("*").alias(out)).orderBy(F.desc(out), *pair).limit(limit)


def spread(df: DataFrame, array: str, key: str, out: str = "episodes") -> DataFrame:
    """How many different keys each element of an array column has."""
    return df.select(key, F.explode(array).alias("element")).groupBy("element").agg(F.count_distinct(key).alias(out))


def top(counts: DataFrame, count: str, limit: int, *ties: str) -> DataFrame:
    """The rows with the highest counts; ties go by the named columns."""
    return counts.orderBy(F.desc(count), *ties).limit(limit)


def repeated(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out)).where(F.col(out) > 1)


def timeline(*parts: DataFrame) -> DataFrame:
    """Parts of one shape as one table; it is ordered only where it is read."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def ordinals(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)


def partition_check(df: DataFrame, key: str, state: str, states: list[str]) -> DataFrame:
    """``shared, queued, total``: keys in several queues, rows in any, and all rows."""
    shared = df.groupBy(key).agg(F.count_distinct(state).alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared"))
    counted = df.agg(F.count_if(F.col(state).isin(states)).alias("queued"), F.count("*").alias("total"))
    return shared.join(counted)


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    return timeline(*[t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in tables.items()])


def latest_verdicts(verdicts: DataFrame, cursor: Column | None = None) -> DataFrame:
    """The verdict of every episode as of a cursor."""
    from tallyloom.operators.asof import latest

    return latest(verdicts, ["episode_id"], ["cursor_at"], cursor)


def disposition_overview(verdicts: DataFrame, cursor: Column) -> DataFrame:
    rows = latest_verdicts(verdicts, cursor)
    return overview(rows, "disposition", ["CLOSED", "PENDING", "EXCEPTION"], {
        "episodes": F.count("*"), "expected_cents": F.sum(F.col("expected_cents") + F.col("expected_rebate_cents")), "received_cents": F.sum(F.col("received_cents") + F.col("received_rebate_cents")),
        "variance_cents": F.sum(F.abs("variance_cents") + F.abs("variance_rebate_cents")), "reopened": F.count_if(F.col("reopened_from").isNotNull()),
    })


def episode_history(verdicts: DataFrame) -> DataFrame:
    """Verdicts that changed something, per episode in order."""
    from tallyloom.operators.asof import changes

    return changes(verdicts, ["episode_id"], ["cursor_at"], ["reimbursement_code", "rebate_code", "disposition", "reasons"])


def feed_exceptions(deposits: DataFrame, allocations: DataFrame, parked: DataFrame, raw: DataFrame) -> dict[str, DataFrame]:
    """Deposits that nothing claims, residual cash, what waits, and payloads that came twice."""
    from tallyloom.operators.matching import unclaimed

    return {
        "orphan_deposits": unclaimed(deposits, allocations, "bank_id"),
        "residual": allocations.where("basis = 'RESIDUAL'"),
        "parked": parked,
        "park_reasons": parked.groupBy("reason").agg(F.count("*").alias("records")),
        "repeated_payloads": repeated(raw, ["source_system", "payload_sha256"], "deliveries"),
        "repeated_records": repeated(raw.where("source_record_id IS NOT NULL"), ["source_system", "source_record_id"], "deliveries"),
    }


def gated_score(df: DataFrame, keys: list[str], weight: str, value: str, gate: str) -> DataFrame:
    """``score``: 100 times the share of the weights earned, zero if any gate is shut."""
    return df.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) * F.lit(100.0) / F.sum(weight) * F.min(gate)).alias("score"))
