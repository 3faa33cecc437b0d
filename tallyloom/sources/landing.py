"""Stored tables: intermediate ones in the shared folder, and append-only sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set; else, with a local master alone, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if "cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tallyloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written to the shared folder, by the columns ``by``, and read again: computed once, with no lineage to recompute."""
    path = f"{shared_folder(df.sparkSession)}/engine-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table made by ``stored``, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {re.sub(r"(/engine-[^/]*)/.*", r"\1", f) for f in df.inputFiles()}:
        if "/engine-" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def landed(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Raw rows as they are kept: verbatim payload and its hash; never deduplicated."""
    return df.withColumn("payload_sha256", F.sha2(F.col(payload).cast("binary"), 256))


def new_rows(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the sink does not hold yet, one a key; null keys match null keys."""
    once = df.dropDuplicates(keys)
    old = existing.select(*[F.col(k).alias(f"_old_{k}") for k in keys])
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_old_{k}"))
        same = one if same is None else same & one
    return once.join(old, same, "left_anti")


def append_once(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows that are new by ``keys``; returns how many. Running it again appends none."""
    spark = df.sparkSession
    try:
        existing = spark.read.schema(df.schema).parquet(path)
        existing.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = spark.createDataFrame([], df.schema)
    new = stored(new_rows(df, existing, keys), "append")
    new.write.mode("append").parquet(path)
    return new.count()


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of every key: what a mutable table holds after the changes."""
    from tallyloom.operators.asof import latest

    return latest(current.unionByName(changes), keys, [version])


def checked(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df``, whose reading fails at a row that breaks the rule."""
    first = df.columns[0]
    return df.withColumn(first, F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.lit(message))).otherwise(F.col(first)))


def changed_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """File names whose hashes differ between two manifests (``name, sha256``), or that one of them lacks."""
    a, b = left.select("name", F.col("sha256").alias("left_sha256")), right.select("name", F.col("sha256").alias("right_sha256"))
    return a.join(b, "name", "full_outer").where(~F.col("left_sha256").eqNullSafe(F.col("right_sha256")))


def exported(df: DataFrame, path: str) -> None:
    """A table as CSV files with a header; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)
