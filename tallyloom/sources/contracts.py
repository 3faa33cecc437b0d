"""Contracts of vendor rows, and which source may speak about what."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the kinds of a field (fixed values).
KINDS = {
    "TEXT": r"(?s)^.*$",
    "INTEGER": r"^-?[0-9]+$",
    "MONEY": r"^-?[0-9]+(\.[0-9]{1,2})?$",
    "DECIMAL": r"^-?[0-9]+(\.[0-9]+)?$",
    "DATE_ISO": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "DATE_WIRE": r"^[0-9]{8}$",
    "STAMP": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$",
    "NPI": r"^[0-9]{10}$",
    "NDC11": r"^[0-9]{11}$",
}


@dataclass(frozen=True)
class Field:
    """One column of a contract: a kind of ``KINDS``, ``PATTERN`` with its own, or ``CODE`` with a closed list."""

    name: str
    kind: str = "TEXT"
    required: bool = True
    pattern: str | None = None
    codes: tuple[str, ...] = ()
    says: str | None = None

    def fault(self) -> Column:
        """Null, or the field's name and what is wrong."""
        value = F.col(self.name).cast("string")
        empty = value.isNull() | (value == "")
        good = value.isin(*self.codes) if self.kind == "CODE" else value.rlike(self.pattern or KINDS[self.kind])
        wrong = F.when(~empty & ~good, F.lit(f"{self.name}: {self.says or self.kind}"))
        return F.when(empty, F.lit(f"{self.name}: missing")).otherwise(wrong) if self.required else wrong


def violations(contract: list[Field]) -> Column:
    """All faults of a row; other columns than the contract's are let be."""
    return F.filter(F.array(*[f.fault() for f in contract]), lambda x: x.isNotNull())


class Contracts:
    """Contracts by source and version. A source without any passes; an unknown version is a fault."""

    def __init__(self) -> None:
        self._known: dict[str, dict[str, list[Field]]] = {}

    def register(self, source: str, version: str, fields: list[Field]) -> None:
        versions = self._known.setdefault(source, {})
        if version in versions:
            raise ValueError(f"{source} {version} is registered already")
        versions[version] = fields

    def versions(self, source: str) -> list[str]:
        return list(self._known.get(source, {}))

    def current(self, source: str) -> str | None:
        return next(reversed(self._known.get(source, {})), None)

    def split(self, df: DataFrame, source: str, version: str) -> tuple[DataFrame, DataFrame]:
        """Rows that keep the contract, and those that break it with ``violations``."""
        if source not in self._known:
            return df, df.limit(0).withColumn("violations", F.array().cast("array<string>"))
        fields = self._known[source].get(version)
        found = F.array(F.lit(f"unknown version {version}")) if fields is None else violations(fields)
        judged = df.withColumn("violations", found)
        return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def authority_breaches(df: DataFrame, kind: str, source: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Rows whose source may not speak about their kind; the pairs are a fixed list and become literals."""
    may = F.lit(False)
    for k, s in allowed:
        may = may | ((F.col(kind) == k) & (F.col(source) == s))
    return df.where(~F.coalesce(may, F.lit(False)))


def governed_breaches(source: str, fields: dict[str, tuple[str, ...]]) -> Column:
    """Names of non-empty fields that the row's source may not state."""
    found = [F.when((F.coalesce(F.col(f).cast("string"), F.lit("")) != "") & ~F.coalesce(F.col(source).isin(*who), F.lit(False)), F.lit(f)) for f, who in fields.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())
