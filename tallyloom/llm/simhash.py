"""Near duplicates by SimHash: an inverted index on positional bytes, count filtering, verification.

A fingerprint has eight positional bytes. Two fingerprints that differ in three bits or fewer share at least five of the
eight. The index has a posting for every choice of ``TOGETHER`` positions with the bytes there, since the list of one
positional byte alone holds a 256th of all fingerprints, however many there are, and pairs of lists would grow with
their square. Two fingerprints that share m positional bytes meet in C(m, TOGETHER) lists, so the tally of their
common lists gives the tally of their bytes: pairs that reach C(5, TOGETHER) are kept and then verified bit by bit.

Only short lists are joined with themselves. A longer one is dealt in blocks, and every pair of blocks is a cell for one
task, which tallies the bytes of its pairs as arrays and returns only links that connect what its pairs connect. So no
list is held whole, none is written out as all its pairs, and none is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, row_columns, shuffled, text_of, with_row, written
from tallyloom.llm.components import connected_components

BYTES = 8
MAX_BITS = 3
#: The guaranteed minimum of equal bytes among eight when at most three bits differ.
MIN_SHARED = BYTES - MAX_BITS
#: Positional bytes that make one posting: at four, lists stay short up to billions of fingerprints.
TOGETHER = 4
SHINGLE_WORDS = 3
SEED = 42
#: Lists of so many fingerprints are joined with themselves; longer ones are dealt in blocks, of so many each.
PAIRED_LIST, BLOCK = 8, 1024

_UPPER = bytes(range(65, 91))
_LOWER = _UPPER.lower()
_TO_LOWER = bytes.maketrans(_UPPER, _LOWER)


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text, unsigned: a bit is set if it is set in over half the shingle hashes.

    ``A-Z`` are lower-cased, words are runs of other than ASCII white space, a text of fewer
    words is one shingle; a text without words has fingerprint zero.
    """
    import xxhash

    parts = (text or "").encode("utf-8").translate(_TO_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_digest
    n = len(parts) - words + 1
    hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[words - 1 :].tolist())])
    bits = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        bits += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp``: the fingerprint of every row as a long. A null text counts as empty."""

    def of(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint_of(t.as_py(), words) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def _postings(fps: DataFrame, together: int) -> DataFrame:
    """``fp, key``: one row for every choice of positions, the key being its number and the bytes there."""
    keys = []
    for k, chosen in enumerate(combinations(range(BYTES), together)):
        keys.append(_packed(k, chosen))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _packed(k: int, chosen: tuple[int, ...]) -> Column:
    """The choice's number above its bytes, of which there are six at most."""
    key = F.lit(k << 48).cast("long")
    for i, p in enumerate(chosen):
        byte = F.shiftrightunsigned(F.col("fp"), 8 * (BYTES - 1 - p)).bitwiseAND(255)
        key = key.bitwiseOR(F.shiftleft(byte, 8 * i))
    return key


def _tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes the fingerprints of two arrays share, pair by pair."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for p in range(BYTES):
        shift = np.uint64(8 * p)
        x, y = (a >> shift).astype(np.uint8), (b >> shift).astype(np.uint8)
        out += x[:, None] == y[None, :]
    return out


def _connecting(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links, at most one fewer than there are nodes, that connect what a symmetric matrix connects."""
    unseen = np.ones(len(linked), bool)
    for start in range(len(linked)):
        if not unseen[start]:
            continue
        unseen[start] = False
        waiting = [start]
        while waiting:
            at = waiting.pop()
            found = np.flatnonzero(linked[at] & unseen)
            unseen[found] = False
            waiting += found.tolist()
            yield from ((at, f) for f in found.tolist())


def _cell_links(cell: pd.DataFrame) -> pd.DataFrame:
    """Links of one cell: of the pairs between its two blocks, or within its only one."""
    fps = cell["fp"].to_numpy().view(np.uint64)
    block = cell["block"].to_numpy()
    first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    a, b = fps[first], fps[second]
    good = (_tally(a, b) >= MIN_SHARED) & (np.bitwise_count(a[:, None] ^ b[None, :]) <= MAX_BITS)
    linked = np.zeros((len(fps), len(fps)), bool)
    linked[np.ix_(first, second)] = good
    linked |= linked.T
    pairs = np.array(list(_connecting(linked)), np.int64).reshape(-1, 2)
    ends = np.sort(fps.view(np.int64)[pairs], axis=1)
    return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})


def links(fps: DataFrame, together: int = TOGETHER, paired: int = PAIRED_LIST, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect all that differ in ``MAX_BITS`` or fewer.

    A pair that meets in a dealt list is tallied there, byte by byte. Any other meets in short lists only, so that the count of
    those is its whole tally.
    """
    spark = fps.sparkSession
    spread = fps.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "fp")
    postings = _postings(spread, together)
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = written(postings.join(shuffled(lists), "key"), "postings")

    short = live.where(F.col("n") <= paired)
    a, b = short.alias("a"), short.alias("b")
    pairs = a.join(shuffled(b), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("lists")).where(F.col("lists") >= comb(MIN_SHARED, together))
    found = counted.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")

    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = live.where(F.col("n") > paired).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = other.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp")
    return found.unionAll(cells.groupBy("key", "low", "high").applyInPandas(_cell_links, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, together: int = TOGETHER, paired: int = PAIRED_LIST, block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the least ``doc_id`` that can be reached over
    fingerprints that differ in at most three bits. A null text counts as empty, and empty texts (fingerprint zero) are linked
    like any other. Repeated rows each give a row. A null ``doc_id`` is kept and never names a component unless the whole
    component has none. An empty table gives an empty result.
    """
    docs_fp, labels = _labelled(docs, words, together, paired, block)
    return docs_fp.join(shuffled(labels), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(docs: DataFrame, words: int, together: int, paired: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, fp`` of every row, and ``fp, component, component_id`` of every fingerprint."""
    docs_fp = written(fingerprints(docs, words), "fingerprints")
    distinct = written(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = connected_components(links(distinct.select("fp"), together, paired, block), "a", "b")
    members = distinct.join(shuffled(linked), distinct["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    members = written(members, "members")
    drop_written(distinct)
    named = members.groupBy("component").agg(F.min("least").alias("component_id"))
    return docs_fp, written(members.join(shuffled(named), "component").select("fp", "component", "component_id"), "labels")


def keep_one_of_each_group(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` without the near duplicates: one row of every component stays.

    It is the row with the least ``doc_id`` that is not null; of rows that share it, or of a component without ids, the one with
    the least hash of its text, and of rows that repeat both any one. An empty table stays empty.
    """
    docs_fp, labels = _labelled(docs, words, TOGETHER, PAIRED_LIST, BLOCK)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("the_id"), "text_hash")
    stays = docs_fp.join(shuffled(labels), "fp").groupBy("component").agg(F.min(order).alias("least")).select("least.*")
    own = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("the_id"), F.xxhash64(text_of()).alias("text_hash")]
    at = ["no_id", "the_id", "text_hash"]
    kept = with_row(docs, *own).join(shuffled(stays), at, "left_semi").dropDuplicates(at)
    return kept.select(*row_columns(kept))
