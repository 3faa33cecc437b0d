"""Arrivals as a stream: files of raw rows, normalised and appended batch by batch, and only touched cases evaluated anew."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyloom.operators.asof import latest
from tallyloom.operators.normalize import adapted, screened

RAW_SCHEMA = "raw_id string, source_id string, source_system string, source_record_id string, file string, line_no bigint, received_at string, payload_sha256 string, payload string"
OUT = [c.split()[0] for c in RAW_SCHEMA.split(", ")] + ["why"]
#: The state store that keeps keyed state on disk (a name of Spark's).
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """Raw rows from Parquet files as they appear in a folder. Nothing is ever too late, so there is no watermark."""
    return spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", most_files).parquet(folder)


class FirstDelivery(StatefulProcessor):
    """Lets the first row of a key through, by its stamp and raw id within a batch, and none ever after."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "raw_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [r.sort_values(["received_at", "raw_id"]).head(1) for r in rows]
        if parts and not self.seen.exists():
            first = pd.concat(parts).sort_values(["received_at", "raw_id"]).head(1)
            self.seen.update((first["raw_id"].iloc[0],))
            yield first[OUT]

    def close(self) -> None:
        pass


def first_deliveries(screened_rows: DataFrame) -> DataFrame:
    """A stream of screened rows, each source's record id once however far apart its copies come, and unreadable rows once by raw id.

    The keys that were seen are in the state store, where a batch looks up its own keys only: what it reads does not grow with
    what has been taken in. A copy's children ride on its row, so they go with it.
    """
    own = F.when(F.col("why").isNull(), F.col("source_record_id"))
    keyed = screened_rows.withColumns({"own": own.isNotNull(), "key": F.coalesce(own, F.col("raw_id"))})
    return keyed.groupBy("source_system", "own", "key").transformWithStateInPandas(FirstDelivery(), f"{RAW_SCHEMA}, why string", "append", "none")


def ingest(spark: SparkSession, folder: str, records_path: str, quarantine_path: str, checkpoint: str) -> StreamingQuery:
    """Normalise what has arrived and append it by batch. A batch that is run again writes its own files anew, so it appends nothing twice."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def batch(rows: DataFrame, number: int) -> None:
        records, refused = adapted(rows)
        records.write.mode("overwrite").parquet(f"{records_path}/batch={number}")
        refused.write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")

    once = first_deliveries(screened(arrivals(spark, folder)))
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def touched(new_records: DataFrame, attachments: DataFrame) -> DataFrame:
    """Episodes that new records attach to: only these can have another verdict, for age is no input of a rule."""
    return attachments.join(new_records.select("record_id"), "record_id", "left_semi").select("episode_id").distinct()


def running_latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of every key of a stream, for ``complete`` or ``update`` output."""
    return latest(events, keys, order)


def arrivals_by_day(events: DataFrame, stamp: str, late_by: str = "45 days") -> DataFrame:
    """Arrivals by day of a stream whose lateness is bounded: an extra beside the engine's own unbounded streams."""
    return events.withWatermark(stamp, late_by).groupBy(F.window(stamp, "1 day").alias("day")).agg(F.count("*").alias("arrivals")).select(F.col("day.start").alias("day"), "arrivals")
