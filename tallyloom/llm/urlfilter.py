"""URL rules by a sort-merge range join over reversed-host keys, in DataFrame functions alone.

The labels of a host in reverse, each closed by a low character, make the hosts under a rule's host one interval
of keys; intervals of different rules are nested or apart. A sweep over the rules' end points keeps the
stack of active rules and cuts the keys into segments, each with its stack. The distinct hosts and the segment
starts are sorted together over the cluster, and every host takes the last segment that began before it: in its
partition, or else the last one of an earlier partition. The rows themselves move once, to join the stack of
their host; a host that has very many is a skewed join that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import row_columns, with_row, written

#: (verdict, host, path prefix) of the rules; a rule holds for its host and all subdomains.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT = "allow"
#: Closes a label in a key, and what comes right after it in the order of keys.
CLOSE, AFTER = "\x01", "\x02"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_key(host: str) -> str:
    return "".join(label + CLOSE for label in reversed(host.split(".")))


def segments(rules: list[tuple[str, str, str]]) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """(start key, stack of rules as (verdict, host, path)) of each segment; the widest rule comes first in a stack.

    Rules are a parameter, so their number is bounded; the sweep sorts their end points once.
    """
    hosts: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in dict.fromkeys(rules):
        hosts.setdefault(host_key(host), []).append((verdict, host, path))
    ends = sorted([(key, 1, key) for key in hosts] + [(key[:-1] + AFTER, 0, key) for key in hosts])
    stack: list[str] = []
    out: dict[str, list[tuple[str, str, str]]] = {}
    for at, opens, key in ends:
        if opens:
            stack.append(key)
        else:
            stack.remove(key)
        out[at] = [r for k in stack for r in sorted(hosts[k], key=lambda r: (len(r[2]), r[2], r[0]))]
    return sorted(out.items())


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ``A-Z`` lower-cased; else empty."""
    rest = F.split(url, "://", 2).getItem(1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.translate(host, _UPPER, _UPPER.lower())).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.split(url, "://", 2).getItem(1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise(F.lit(""))


def _starts(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    schema = "key string, stack array<struct<verdict:string,host:string,path:string>>"
    return spark.createDataFrame(segments(rules), schema)


def host_stacks(hosts: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``host, stack`` for distinct hosts: the rules whose host is the host itself or above it, the widest first."""
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), CLOSE), F.lit(CLOSE))
    keys = hosts.select(key.alias("key"), F.lit(1).alias("is_host"), "host")
    starts = _starts(hosts.sparkSession, rules).select("key", F.lit(0).alias("is_host"), F.struct("stack").alias("segment"))
    both = keys.unionByName(starts, allowMissingColumns=True)
    swept = both.repartitionByRange("key", "is_host").sortWithinPartitions("key", "is_host")
    swept = written(swept.withColumn("part", F.spark_partition_id()), "swept")

    tops = swept.groupBy("part").agg(F.max_by("segment", F.when(F.col("is_host") == 0, F.col("key"))).alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    here = Window.partitionBy("part").orderBy("key", "is_host").rowsBetween(Window.unboundedPreceding, 0)
    found = swept.withColumn("own", F.last("segment", ignorenulls=True).over(here)).where("is_host = 1")
    # One row for each partition of the sweep: as many as there are shuffle partitions, whatever the input.
    found = found.join(F.broadcast(carried), "part")
    return found.select("host", F.coalesce("own", "carried").getField("stack").alias("stack"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """The columns of ``pages`` and ``host, path, rule, verdict`` of every ``url``.

    A rule fits if the url's host is the rule's or below it and the url's path starts with the rule's. The rule with the
    longest host wins, then the one with the longest path; of two that differ in the verdict alone, block.
    ``rule`` is its host and path, null where none fits, and the verdict is then ``default``. A null url or one without
    ``://`` has an empty host and path. Repeated rows are each judged, and an empty table stays empty. Input columns
    named like the added ones give way.
    """
    rows = with_row(pages, F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    hosts = rows.select("host").distinct()
    found = rows.join(host_stacks(hosts, rules).withColumnRenamed("host", "swept_host"), F.col("host") == F.col("swept_host"))

    def fits(r: Column) -> Column:
        below = (F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))
        return below & F.startswith(F.col("path"), r["path"])

    fitting = F.filter(F.col("stack"), fits)
    judged = found.withColumn("best", F.when(F.size(fitting) > 0, F.element_at(fitting, -1)))
    return judged.select(
        *row_columns(judged, but=("host", "path", "rule", "verdict")),
        "host",
        "path",
        F.concat(F.col("best.host"), F.col("best.path")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
