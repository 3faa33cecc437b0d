"""Exact dedup over an extendible-hash index that is kept as tables in the shared folder.

A directory names the bucket of every leading-bits slot of a text's 64-bit key: a bucket over its capacity is split by one bit more and
the directory doubles, until every bucket fits. Owner tasks take ranges of keys. Texts of a key meet there: equal bytes are one group, and texts that
only share the key are chained. The index has an entry for every place of a chain: key, length, SHA-256, how many rows have the text, and the
``doc_id`` that stays. A document finds its entry as in any such index: slot, bucket, key, and then its place in the chain.

Copies are merged before they move to their owner, so a text that a third of all rows have arrives as a few rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, row_columns, shuffled, text_of, with_row, written

#: Index entries that a bucket holds before it is split.
BUCKET_ENTRIES = 8192
KEY_BITS = 64
#: Rows that a text leaves at most when its copies move to their owner; tasks for copies without an id.
SALTS = 16


def _text_key(text: Column) -> Column:
    """The 64-bit key, its sign bit flipped: the order of longs is then that of the unsigned key."""
    return F.xxhash64(text).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _slot(key: Column, bits: int) -> Column:
    if bits == 0:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(1 << 63)).cast("long")), KEY_BITS - bits)


def _slots(index: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """``slot, n`` at the bits to which the directory has to double: then no slot holds more than ``capacity`` entries.

    Only a single key that has more entries than that stays together: no further bit can part them.
    """
    bits = min(KEY_BITS, math.ceil(math.log2(max(1.0, index.count() / capacity))))
    while True:
        slots = index.groupBy(_slot(F.col("key"), bits).alias("slot")).agg(F.count("*").alias("n"))
        most = slots.agg(F.max("n")).first()[0] or 0
        if most <= capacity or bits == KEY_BITS:
            return slots, bits
        bits = min(KEY_BITS, bits + max(1, math.ceil(math.log2(most / capacity))))


def directory(index: DataFrame, capacity: int = BUCKET_ENTRIES) -> tuple[DataFrame, int]:
    """``slot, depth, bucket`` and the directory's bits, for an index with a column ``key``.

    A bucket of depth d holds the keys with the same d leading bits. The bucket of a slot is the shallowest that has at
    most ``capacity`` entries: what splitting overfull buckets one bit at a time leads to.
    """
    slots, bits = _slots(index, capacity)
    depths = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    prefix = F.call_function("shiftrightunsigned", F.col("slot"), (F.lit(bits) - F.col("depth")).cast("int"))
    loads = depths.withColumn("bucket", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(prefix))
    held = loads.groupBy("depth", "bucket").agg(F.sum("n").alias("load"))
    fits = loads.join(held, ["depth", "bucket"]).where((F.col("load") <= capacity) | (F.col("depth") == bits))
    best = fits.groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("b"))
    return best.select("slot", F.col("b.depth").alias("depth"), F.col("b.bucket").alias("bucket")), bits


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_index(docs: DataFrame, capacity: int = BUCKET_ENTRIES, key_of=_text_key) -> tuple[DataFrame, DataFrame, int]:
    """The index ``bucket, key, chain_place, n_bytes, sha, group_size, keep_id``, its directory, and that one's bits.

    The directory is laid out by digests, which are small. Then the texts go to their owners: copies are merged within a salt of
    their id, which leaves a hot text a few rows, and each owner takes a range of keys, compares the texts of a key byte by byte, and chains
    those that differ. What it finds there is the group. ``key_of`` gives a text's key; a weaker one makes longer chains and the same groups.
    """
    texts = docs.select("doc_id", text_of().alias("text")).select("doc_id", key_of(F.col("text")).alias("key"), "text")
    digests = written(texts.select("key", F.octet_length("text").alias("n_bytes"), _digest(F.col("text")).alias("sha")).distinct(), "digests")
    slots, bits = directory(digests, capacity)
    slots = written(slots, "directory")
    drop_written(digests)
    salted = texts.groupBy("key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), "text").agg(F.count("*").alias("n"), F.max("doc_id").alias("id"))
    at_owner = salted.repartitionByRange("key")
    told = at_owner.groupBy("key", "text").agg(F.sum("n").alias("group_size"), F.max("id").alias("keep_id"))
    entries = told.select("key", F.octet_length("text").alias("n_bytes"), _digest(F.col("text")).alias("sha"), "group_size", "keep_id")
    chain = Window.partitionBy("key").orderBy("n_bytes", "sha")
    again = (F.lag("sha").over(chain) == F.col("sha")) & (F.lag("n_bytes").over(chain) == F.col("n_bytes"))
    chained = entries.select("*", F.row_number().over(chain).alias("chain_place"), F.coalesce(again, F.lit(False)).alias("again"))
    # A chain's texts differ in their bytes, so probes could not tell two of one digest apart.
    place = F.when(F.col("again"), F.raise_error(F.lit("two texts with one SHA-256 differ")).cast("int")).otherwise(F.col("chain_place"))
    placed = chained.withColumn("slot", _slot(F.col("key"), bits)).join(slots.select("slot", "bucket"), "slot")
    index = written(placed.select("bucket", "key", place.alias("chain_place"), "n_bytes", "sha", "group_size", "keep_id"), "index")
    return index, slots, bits


def exact_duplicates(docs: DataFrame, capacity: int = BUCKET_ENTRIES, key_of=_text_key) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the largest ``doc_id``
    stays; a null ``doc_id`` stays only where no other row of the group has one. Rows that repeat both ``doc_id`` and
    text each give a row, the same one, and each count in ``group_size``. An empty table gives an empty result. Should two
    texts with one SHA-256 differ, the query fails.
    """
    index, slots, bits = exact_index(docs, capacity, key_of)
    text = docs.select("doc_id", text_of().alias("text"))
    probes = text.select("doc_id", key_of(F.col("text")).alias("key"), F.octet_length("text").alias("n_bytes"), _digest(F.col("text")).alias("sha"))
    placed = probes.withColumn("slot", _slot(F.col("key"), bits)).join(slots.select("slot", "bucket"), "slot")
    found = placed.join(index, ["bucket", "key", "n_bytes", "sha"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for every distinct text, that of the largest ``doc_id``; of rows that repeat it, any one.

    A null text counts as empty. Where no row of a text has an id, any one of them stays. An empty table gives an empty one. The rows
    move once, to the index entries that name them, and what repeats a ``doc_id`` there lies together already; rows without an id, which
    may be very many of one text, are dealt over ``SALTS`` tasks and only the one that each task leaves meets the others.
    """
    index, _, _ = exact_index(docs)
    text = text_of()
    entry = [_text_key(text).alias("key"), F.octet_length(text).alias("n_bytes"), _digest(text).alias("sha")]
    at = ["key", "n_bytes", "sha"]
    named = with_row(docs.where("doc_id IS NOT NULL"), *entry, F.col("doc_id").alias("the_id"))
    stays = index.where("keep_id IS NOT NULL").select(*at, F.col("keep_id").alias("the_id"))
    kept = named.join(shuffled(stays), [*at, "the_id"], "left_semi").dropDuplicates([*at, "the_id"])
    # Tables mostly have no rows without an id, which their files' statistics tell before anything is read.
    nameless = with_row(docs.where("doc_id IS NULL"), *entry, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    alone = index.where("keep_id IS NULL").select(*at, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    one = nameless.join(shuffled(alone), [*at, "salt"], "left_semi").dropDuplicates([*at, "salt"]).dropDuplicates(at)
    return kept.select(*row_columns(kept)).unionByName(one.select(*row_columns(one)))
