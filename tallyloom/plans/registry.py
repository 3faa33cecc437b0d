"""Where the queries on the driver's tables register, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The cursor of the as-of queries on events, and the one of those on orders.
EVENT_CURSOR = "2024-01-15 23:59:59"
ORDER_CURSOR = "1998-06-30"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


#: What an event's type says about its case (fixed values of the harness).
STATES = {"purchase": "CLOSED", "view": "PENDING", "click": "PENDING", "signup": "EXCEPTION", "error": "EXCEPTION"}


def state_of(column: str = "event_type"):
    return F.element_at(F.create_map(*[F.lit(x) for p in STATES.items() for x in p]), F.col(column))


STATE_SQL = "CASE event_type WHEN 'purchase' THEN 'CLOSED' WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'PENDING' ELSE 'EXCEPTION' END"


def cents(column: str):
    from tallyloom.functions.money import double_cents

    return double_cents(F.col(column))


def cents_sql(column: str) -> str:
    return f"CAST(round({column} * 100) AS BIGINT)"
