"""Files as rows with their place: the file, its SHA-256, and the line or row number as a person would count it.

Files of lines are split by Spark like any text. The number of a line is its place in its split and how many lines the splits before it
have, so nothing is counted in one task. Delimited files go whole to a task, as a quoted cell may hold line breaks and so no split
can know where a row begins; each is read by its own header, whatever the order of its columns. All reading is Spark's, so a
file can lie in any store that Spark knows.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.sources.landing import stored

ROWS = "file string, file_sha256 string, line_no long, record_type string, record_count string, payload string"
#: Where a trailer says how many rows there should be (fixed values).
COUNT_COLUMNS = ("record_count", "declared_record_count")
DETAIL, TRAILER = "DETAIL", "TRAILER"
_BATCH_BYTES = 8 << 20


class UnreadableFile(ValueError):
    """A file whose header or bytes cannot be understood; nothing of it lands."""


def contents(spark: SparkSession, paths: list[str] | tuple[str, ...]) -> DataFrame:
    """``file, modified_at, n_bytes, file_sha256, content`` of every file; of equal files the first by its path."""
    files = spark.read.format("binaryFile").load(list(paths))
    named = files.select(F.col("_metadata.file_path").alias("file"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("file_sha256"), "content")
    once = named.groupBy("file_sha256").agg(F.min("file").alias("file"))
    return named.join(once, ["file", "file_sha256"], "left_semi")


def file_hashes(spark: SparkSession, source_id: str, paths: list[str] | tuple[str, ...]) -> DataFrame:
    """``source_id, name, modified_at, n_bytes, sha256`` of the files of a source, for ``feeds.new_files``."""
    found = contents(spark, paths)
    return found.select(F.lit(source_id).alias("source_id"), F.col("file").alias("name"), "modified_at", "n_bytes", F.col("file_sha256").alias("sha256"))


def read_lines(spark: SparkSession, paths: list[str] | tuple[str, ...]) -> DataFrame:
    """``file, file_sha256, line_no, payload`` of every line that is not blank; lines count from 1, blank ones too."""
    hashes = contents(spark, paths).select("file", "file_sha256")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    # The order within a split holds in one reading only, so lines are stored with it before they are counted.
    lines = stored(spark.read.text(list(paths)).select(F.col("value").alias("payload"), *place), "lines")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = lines.join(blocks, ["file", "block"]).withColumn("line_no", F.col("at") - F.col("first") + F.col("earlier") + 1)
    return numbered.where(F.trim("payload") != "").join(hashes, "file").select("file", "file_sha256", "line_no", "payload")


def rows_of(name: str, content: bytes, needed: tuple[str, ...] | None, renames: dict[str, str]) -> Iterator[tuple[int, str | None, str | None, str]]:
    """``row number, record type, declared count, payload`` of a delimited file; the row below the header is 2.

    The payload is JSON with sorted keys and without empty cells. Cells beyond the header are kept under ``_more``.
    With ``needed`` the header has to have these columns and no others, in any order.
    """
    try:
        text = io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", newline="")
        rows = csv.reader(text, strict=True)
        header = [c.strip() for c in next(rows, [])]
        if not header and not content.strip():
            return
        if "" in header or len(set(header)) < len(header):
            raise UnreadableFile(f"{name}: the header has an unnamed or repeated column: {header}")
        if needed is not None and set(header) != set(needed):
            raise UnreadableFile(f"{name}: the header lacks {sorted(set(needed) - set(header))} and has unknown {sorted(set(header) - set(needed))}")
        kind = header.index("record_type") if "record_type" in header else None
        number = 1
        for cells in rows:
            if not cells:
                continue
            number += 1
            record = {renames.get(c, c): v for c, v in zip(header, cells) if v != ""}
            if len(cells) > len(header):
                record["_more"] = cells[len(header) :]
            count = next((record[c] for c in COUNT_COLUMNS if c in record), None)
            what = None if kind is None else cells[kind] if kind < len(cells) else ""
            yield number, what, count, json.dumps(record, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    except (UnicodeDecodeError, csv.Error) as e:
        raise UnreadableFile(f"{name}: {e}") from e


def read_delimited(spark: SparkSession, paths: list[str] | tuple[str, ...], needed: tuple[str, ...] | None = None, renames: dict[str, str] | None = None) -> DataFrame:
    """``ROWS`` of delimited files with a header. ``record_type`` is null where the header has no such column."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "file_sha256", "line_no", "record_type", "record_count", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)

        for batch in batches:
            for file, sha, content in zip(*(batch.column(c) for c in ("file", "file_sha256", "content"))):
                held, size = [], 0
                for row in rows_of(file.as_py(), content.as_py(), needed, renames or {}):
                    held.append((file.as_py(), sha.as_py(), *row))
                    size += len(row[3]) + 200
                    if size > _BATCH_BYTES:
                        yield out(held)
                        held, size = [], 0
                if held:
                    yield out(held)

    return contents(spark, paths).select("file", "file_sha256", "content").mapInArrow(of, ROWS)
