"""Integrity of reference tables: what is declared about them, compiled to one table of breaches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dimension up to this many rows may be broadcast.
MOST_BROADCAST = 100_000
#: Rows that a task groups or sorts, about.
TASK_ROWS = 1_000_000


@dataclass(frozen=True)
class Key:
    """No two rows share these columns, and none of them is null."""

    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    """Where none of these columns is null, a row of another table has them."""

    table: str
    columns: tuple[str, ...]
    to: str
    to_columns: tuple[str, ...]


@dataclass(frozen=True)
class Check:
    """A condition (SQL) that holds in every row; one that is null does not hold."""

    table: str
    name: str
    condition: str


@dataclass(frozen=True)
class Exclusive:
    """The half-open spans of one ``key`` do not overlap, and each ends after it starts. A span without an end goes on for ever."""

    table: str
    key: tuple[str, ...]
    start: str
    end: str


@dataclass(frozen=True)
class Rows:
    """At least, and at most, so many rows satisfy a condition."""

    table: str
    name: str
    condition: str
    least: int = 0
    most: int | None = None


Constraint = Key | Reference | Check | Exclusive | Rows


def _named(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _out(df: DataFrame, table: str, rule: Column | str, row: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), row.alias("row"))


def _missing(columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def _checks(rows: DataFrame, table: str, found: list[Check], ids: tuple[str, ...]) -> DataFrame:
    """All conditions of a table in one pass over it."""
    failed = F.array(*[F.when(~F.coalesce(F.expr(c.condition), F.lit(False)), F.lit(f"CHECK {c.name}")) for c in found])
    return _out(rows.select("*", F.explode(F.filter(failed, lambda f: f.isNotNull())).alias("_rule")), table, F.col("_rule"), _named(ids))


def _dealt(rows: DataFrame, columns: tuple[str, ...], task_rows: int) -> DataFrame:
    """``rows`` dealt by ``columns`` to tasks of about ``task_rows`` rows each, so that a larger table takes more tasks and not larger ones."""
    return rows.repartition(max(1, -(-rows.count() // task_rows)), *columns)


def _keys(rows: DataFrame, k: Key, task_rows: int = TASK_ROWS) -> DataFrame:
    rule = f"KEY {','.join(k.columns)}"
    twice = _dealt(rows.select(*k.columns), k.columns, task_rows).groupBy(*k.columns).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | _missing(k.columns))
    return _out(twice, k.table, rule, _named(k.columns))


def _references(rows: DataFrame, target: DataFrame, r: Reference) -> DataFrame:
    """Each dangling value once. Only distinct values meet the other table."""
    own = rows.where(~_missing(r.columns)).select(*r.columns).distinct()
    there = target.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(r.to_columns)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_t{i}") for i, c in enumerate(r.columns)])
    return _out(own.join(there, same, "left_anti"), r.table, f"REFERENCE {','.join(r.columns)} TO {r.to}", _named(r.columns))


def _spans(rows: DataFrame, e: Exclusive, task_rows: int = TASK_ROWS) -> DataFrame:
    """A span breaks the rule where an earlier one of its key ends after its start: the latest end so far decides, and no pairs are made."""
    order = Window.partitionBy(*e.key).orderBy(F.asc_nulls_first(e.start), F.asc_nulls_last(e.end)).rowsBetween(Window.unboundedPreceding, -1)
    own = _dealt(rows.select(*dict.fromkeys((*e.key, e.start, e.end))), e.key, task_rows)
    before = own.select(*e.key, e.start, e.end, F.count("*").over(order).alias("_n"), F.max(e.end).over(order).alias("_most"), F.bool_or(F.col(e.end).isNull()).over(order).alias("_open"))
    over = (F.col("_n") > 0) & (F.coalesce("_open", F.lit(False)) | (F.col("_most") > F.col(e.start)))
    empty = F.coalesce(F.col(e.end) <= F.col(e.start), F.lit(False)) | F.col(e.start).isNull()
    return _out(before.where(over | empty), e.table, f"EXCLUSIVE {e.start}..{e.end} BY {','.join(e.key)}", _named((*e.key, e.start)))


def _rows(rows: DataFrame, r: Rows) -> DataFrame:
    n = rows.agg(F.count_if(F.expr(r.condition)).alias("_n"))
    wrong = F.col("_n") < r.least
    if r.most is not None:
        wrong = wrong | (F.col("_n") > r.most)
    return _out(n.where(wrong), r.table, f"ROWS {r.name}", F.col("_n").cast("string"))


def breaches(tables: dict[str, DataFrame], declared: list[Constraint], ids: dict[str, tuple[str, ...]]) -> DataFrame:
    """``table, rule, row`` of everything that breaks what is ``declared``: one plan, empty where all holds.

    ``ids`` names the columns by which a row of a table is reported for its checks. An undeclared table is refused.
    """
    unknown = {c.table for c in declared} | {c.to for c in declared if isinstance(c, Reference)}
    if unknown - tables.keys():
        raise KeyError(f"no such tables: {sorted(unknown - tables.keys())}")
    parts = []
    for name in dict.fromkeys(c.table for c in declared):
        own = [c for c in declared if c.table == name]
        if checks := [c for c in own if isinstance(c, Check)]:
            parts.append(_checks(tables[name], name, checks, ids[name]))
        for c in own:
            if isinstance(c, Key):
                parts.append(_keys(tables[name], c))
            elif isinstance(c, Reference):
                parts.append(_references(tables[name], tables[c.to], c))
            elif isinstance(c, Exclusive):
                parts.append(_spans(tables[name], c))
            elif isinstance(c, Rows):
                parts.append(_rows(tables[name], c))
    return reduce(lambda a, b: a.unionByName(b), parts)


class BrokenReference(ValueError):
    """Reference data that the rest of the work cannot rely on."""


def demand(found: DataFrame) -> None:
    """Stops where there are breaches, naming how many of each rule and the first such row."""
    worst = found.groupBy("table", "rule").agg(F.count("*").alias("n"), F.min("row").alias("row")).orderBy("table", "rule").collect()
    if worst:
        raise BrokenReference("; ".join(f"{r['table']}: {r['rule']}: {r['n']} rows such as {r['row']}" for r in worst))


def with_dimension(rows: DataFrame, dimension: DataFrame, key: str, columns: list[str], most: int = MOST_BROADCAST) -> DataFrame:
    """``rows`` with ``columns`` of the dimension's row of the same ``key``, null where there is none.

    A dimension of at most ``most`` rows is broadcast; a larger one is joined by a shuffle. A key that the dimension has twice is refused
    where it is met, as it would double rows.
    """
    own = dimension.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_d_{c}") for c in columns])
    once = own.groupBy("_key").agg(F.count("*").alias("_n"), *[F.first(f"_d_{c}").alias(f"_d_{c}") for c in columns])
    small = dimension.limit(most + 1).count() <= most
    both = rows.join(F.broadcast(once) if small else once, F.col(key) == F.col("_key"), "left")
    told = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"the dimension has two rows of {key} "), F.col(key).cast("string"))))
    kept = [c for c in rows.columns if c not in columns]
    return both.select(*kept, *[F.coalesce(told.cast(dimension.schema[c].dataType), F.col(f"_d_{c}")).alias(c) for c in columns])


def known_codes_only(rows: DataFrame, keys: str, key_type: str, code: str, dimension: DataFrame, dim_code: str) -> DataFrame:
    """``rows`` whose array ``keys`` has no key of ``key_type`` where ``code`` is not one of the dimension's."""
    known = with_dimension(rows, dimension.select(F.col(dim_code).alias(code)).distinct().withColumn("_known", F.lit(True)), code, ["_known"])
    kept = F.filter(keys, lambda k: F.coalesce(F.col("_known"), F.lit(False)) | (k["key_type"] != key_type))
    return known.withColumn(keys, kept).select(*rows.columns)
