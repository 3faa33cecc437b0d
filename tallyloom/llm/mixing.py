"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

The mean repetition rate of a source is what brings its share of characters to its target weight. A document's count
of copies is Poisson with that mean, inverted at uniform numbers hashed from its id: it depends on nothing but the
id, the seed and the rate. A large mean is a sum of draws with means of ``DRAW_MEAN`` at most, which is Poisson again,
so the distribution that is inverted has a few dozen steps whatever the rate. Documents are exploded by their count
and sorted by a hash of id and copy over the whole cluster.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import row_columns, text_of, with_row

#: Weight of all sources that the targets do not name, taken together.
OTHER = "*"
#: Shares of characters that the mix aims at; together one.
TARGETS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.05, OTHER: 0.55}
SEED = 20240229
#: Sources that targets may name: each is a row of the table of rates, which is broadcast.
MAX_TARGETS = 1000
#: The largest mean that is inverted at one uniform number.
DRAW_MEAN = 16.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts joined by colons."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until less than 2**-53 is left. ``mean`` is at most ``DRAW_MEAN``."""
    if mean <= 0:
        return [1.0]
    out, total, k = [], 0.0, 0
    while k <= mean or 1.0 - total > 2.0**-53:
        term = math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        total += term
        out.append(min(total, 1.0))
        k += 1
        if k > mean and term < 2.0**-60:
            break
    return out


def draws_of(rate: float) -> int:
    """How many draws of equal means up to ``DRAW_MEAN`` make up a rate."""
    return max(1, math.ceil(rate / DRAW_MEAN))


def rates(docs: DataFrame, targets: dict[str, float], epochs: float = 1.0) -> dict[str, float]:
    """Mean repetitions of each target's documents; a target without characters gets rate zero and leaves its weight to the others.

    One aggregate with at most a group for each target comes to the driver.
    """
    named = [s for s in targets if s != OTHER]
    if len(named) > MAX_TARGETS:
        raise ValueError(f"at most {MAX_TARGETS} sources can have a target")
    pool = F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit(OTHER))
    sizes = {r["pool"]: r["size"] for r in docs.groupBy(pool.alias("pool")).agg(F.sum(F.char_length(text_of())).alias("size")).collect()}
    total = sum(sizes.values())
    weight = sum(w for s, w in targets.items() if sizes.get(s))
    return {s: (w / weight * total * epochs / sizes[s] if sizes.get(s) else 0.0) for s, w in targets.items()}


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, seed: int = SEED, epochs: float = 1.0) -> DataFrame:
    """The mixed documents: the columns of ``docs``, then ``copy`` (from 1), ``copies``, ``mix_key``, in mixed order.

    ``targets`` gives shares of characters by source; sources it does not name share the weight of ``"*"``, or
    drop out where it has none. A null source belongs there, a null text has no characters. The result has
    ``epochs`` times the characters of the input in expectation, as long as a target has any. Rows that repeat a ``doc_id``
    and those without one are each copied as often as the others. Input columns named like the added ones give way. An empty table stays empty.
    """
    mean = rates(docs, targets, epochs)
    known = [{"target": s, "draws": draws_of(mean[s]), "cdf": poisson_cdf(mean[s] / draws_of(mean[s]))} for s in targets]
    table = F.from_json(F.lit(json.dumps(known)), "array<struct<target:string,draws:int,cdf:array<double>>>")
    table = docs.sparkSession.range(1).select(F.inline(table))
    named = [s for s in targets if s != OTHER]
    pool = F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit(OTHER))

    def drawn(j: Column) -> Column:
        u = uniform(F.lit(seed), F.col("id"), j)
        return F.size(F.filter("cdf", lambda c: c <= u))

    first = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    rest = F.aggregate(F.sequence(F.lit(2), F.col("draws")), F.lit(0), lambda n, j: n + drawn(j))
    rows = with_row(docs, pool.alias("pool"), F.col("doc_id").alias("id"), uniform(F.lit(seed), F.col("doc_id")).alias("u"))
    # The table has a row for each target, at most MAX_TARGETS.
    rated = rows.join(F.broadcast(table), F.col("pool") == F.col("target"))
    rows = rated.withColumn("copies", first + F.when(F.col("draws") > 1, rest).otherwise(F.lit(0)))
    repeated = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("copy")).cast("binary")), 1, 16)
    ordered = repeated.withColumn("mix_key", key).withColumn("nth", F.monotonically_increasing_id()).orderBy("mix_key", "id", "copy", "nth")
    return ordered.select(*row_columns(ordered, but=("copy", "copies", "mix_key")), "copy", "copies", "mix_key")
