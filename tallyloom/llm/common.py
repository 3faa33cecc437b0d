"""Shared helpers: the shared folder, tables that cut lineage, and names that cannot clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the cluster names one. Unset: a temporary folder
    with a local master, and the warehouse on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    else:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        spark.sparkContext.setCheckpointDir(f"{warehouse}/_tallyloom_shared")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the folders of a table made by ``written``."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tallyloom-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join, both of whose sides grow with the input and therefore move by the key: neither is ever broadcast.

    Spark would go by its estimates, which hold an exploded table for as large as what it was exploded from, and a file's rows for as large as
    they are on disk.
    """
    return df.hint("merge")


def text_of(col: str = "text") -> Column:
    """The text, a null one counting as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def with_row(df: DataFrame, *keys: Column) -> DataFrame:
    """The whole input row as one struct ``row`` beside ``keys``: no column of the input can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *keys)


def row_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``row`` again, without those named in ``but``."""
    names = df.schema["row"].dataType.fieldNames()
    hidden = {b.lower() for b in but}
    return [F.col("row").getField(n).alias(n) for n in names if n.lower() not in hidden]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
