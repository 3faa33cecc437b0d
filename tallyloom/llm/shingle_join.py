"""Near duplicates by SimHash and, for what fingerprints miss, by a set join with prefix filtering: no pair is lost.

SimHash comes first: documents whose fingerprints the index on positional bytes brings together, and differ in few enough bits,
are compared by their whole sets of shingles and linked. They are most of the near copies, and parts of the join below from the start.

For the join, shingles are brought into one order, those that all documents together have most often last (counted by slots of a hash, so what
is broadcast has a fixed size). A passage that many documents share is then in the prefix of those alone that hardly hold anything else. Two sets with Jaccard similarity ``t`` or more share at
least ``ceil(t * n)`` of the ``n`` shingles of either, so they share one of the first ``n - ceil(t * n) + 1`` of both. Documents
that meet there and whose sizes allow it are first compared by bitmaps that hold the parity of shingles a slot: bitmaps cannot differ in more
bits than the sets do in shingles. Those that may be similar are compared by their whole sets. The order decides the effort, never the result.

What is wanted are the components, not all pairs. So every document that is not in the component of most at a shingle of its
prefix is first compared with one other, the most central of the most common such shingle. Only documents of different components that meet are left for the last comparison, at their first common shingle: what
may follow after that place in both has to suffice for the similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import simhash
from tallyloom.llm.common import drop_written, row_columns, shuffled, text_of, with_row, written
from tallyloom.llm.components import connected_components

SHINGLE_WORDS = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
SEED = 42
#: Slots of the counts by which shingles are ordered, at most, as bits, and of a block of them that tasks hand on.
COUNT_BITS, BLOCK_BITS = 24, 14
#: Slots of a set's parity bitmap, as bits of the hash.
SLOT_BITS = 11

_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_HALF = np.uint64(32)


def hasher(words: int = SHINGLE_WORDS) -> Callable[[str | None], np.ndarray]:
    """Gives the sorted distinct 64-bit hashes of a text's shingles.

    ``A-Z`` are lower-cased, words are runs of other than ASCII white space, a text of fewer words is one shingle.
    """
    import xxhash

    known: dict[bytes, int] = {}

    def of(text: str | None) -> np.ndarray:
        parts = (text or "").encode("utf-8").translate(_TO_LOWER).split()
        if len(parts) < words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
        if len(known) > 200_000:
            known.clear()
        for w in parts:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, SEED)
        one = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        n = len(parts) - words + 1
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled = rolled * _ROLL + one[k : k + n]
        rolled = (rolled ^ (rolled >> _HALF)) * _MIX
        return np.unique(rolled ^ (rolled >> _HALF))

    return of


def _node(hashes: np.ndarray) -> int:
    import xxhash

    n = xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)
    return n - (1 << 64) if n >> 63 else n


def parities(hashes: np.ndarray) -> bytes:
    """One bit a slot: whether an odd number of the shingles falls into it."""
    slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=1 << SLOT_BITS) & 1).astype(np.uint8)).tobytes()


def prefix_of(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set must share one: those of the highest ``levels`` come last in the order."""
    times, over = SIMILAR
    n = len(hashes)
    return hashes[np.argsort(levels[slots_of(hashes, levels)], kind="stable")[: n - -(-times * n // over) + 1]]


def slots_of(hashes: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - len(slots).bit_length())).astype(np.int64)


def shingle_levels(docs: DataFrame, words: int = SHINGLE_WORDS, most_bits: int = COUNT_BITS) -> np.ndarray:
    """How often all documents have the shingles of each slot of the hash, as eight levels a doubling; 2 ** ``most_bits`` bytes at most."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, max(8, n_bytes.bit_length() - 2))
    block = 1 << min(bits, BLOCK_BITS)

    def count(batches):
        shingles = hasher(words)
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, slots_of(shingles(text.as_py()), counts), 1)
        parts = counts.reshape(-1, block)
        for at in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(parts[at].tobytes(), 1)])], names=["at", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(block, np.int64)
        for part in table.column("counts"):
            total += np.frombuffer(zlib.decompress(part.as_buffer()), np.uint32)
        levels = np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)
        return pa.table({"at": table.column("at").slice(0, 1), "levels": pa.array([zlib.compress(levels.tobytes())])})

    counted = docs.select(text_of().alias("text")).mapInArrow(count, "at int, counts binary").groupBy("at").applyInArrow(merge, "at int, levels binary")
    levels = np.zeros((1 << bits) // block * block, np.uint8).reshape(-1, block)
    for row in counted.collect():
        levels[row["at"]] = np.frombuffer(zlib.decompress(row["levels"]), np.uint8)
    return levels.ravel()


def set_table(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, text_hash, node, size, bitmap, prefix, fp``: ``node`` names a document's set of shingles, equal sets alike; ``fp`` is its SimHash."""
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, words))

    def of(batches):
        shingles = hasher(words)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sets = [shingles(t) for t in texts]
            fps = np.fromiter(map(simhash.fingerprint_of, texts), np.uint64, len(texts))
            prefixes = [prefix_of(s, levels.value).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, prefixes)])
            values = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            columns = [
                batch.column("doc_id"), batch.column("text_hash"), pa.array(map(_node, sets), pa.int64()),
                pa.array(map(len, sets), pa.int32()), pa.array(map(parities, sets), pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                pa.array(fps.view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "size", "bitmap", "prefix", "fp"])

    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sets = written(rows.mapInArrow(of, f"doc_id {kind}, text_hash long, node long, size int, bitmap binary, prefix array<long>, fp long"), "sets")
    levels.destroy()
    return sets


def _may_be_similar(sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates`` without pairs whose bitmaps differ in more bits than similar sets do in shingles, with ``s, t``: the hash of a text of each."""
    nodes = candidates.select(F.col("a").alias("node")).unionAll(candidates.select(F.col("b").alias("node"))).distinct()
    known = sets.select("node", "size", "bitmap", "text_hash").join(nodes, "node", "left_semi").groupBy("node")
    known = known.agg(F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), F.min("text_hash").alias("text_hash"))
    known = written(known, "bitmaps")
    left = candidates.join(shuffled(known.toDF("a", "m", "x", "s")), "a")
    both = left.join(shuffled(known.toDF("b", "n", "y", "t")), "b").select("a", "b", "s", "t", (F.col("m") + F.col("n")).alias("sizes"), "x", "y")

    def compare(batches):
        times, over = SIMILAR
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(batch), -1) for c in ("x", "y"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = apart * (over + times) <= batch.column("sizes").to_numpy().astype(np.int64) * (over - times)
            yield batch.select(["a", "b", "s", "t"]).filter(pa.array(keep, pa.bool_()))

    compared = written(both.mapInArrow(compare, "a long, b long, s long, t long"), "compared")
    drop_written(known)
    return compared


def _similar(docs: DataFrame, sets: DataFrame, candidates: DataFrame, words: int) -> DataFrame:
    """Those of ``candidates`` (``a, b``) whose whole sets are similar."""
    candidates = written(candidates.distinct(), "candidates")
    pairs = _may_be_similar(sets, candidates)
    drop_written(candidates)
    wanted = written(pairs.select(F.col("s").alias("text_hash")).unionAll(pairs.select(F.col("t").alias("text_hash"))).distinct(), "wanted")

    def whole(batches):
        shingles = hasher(words)
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, found), pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "shingles"])

    texts = docs.select(F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text")).join(wanted, "text_hash", "left_semi").select("text")
    full = written(texts.mapInArrow(whole, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "whole")
    left = pairs.select("a", "b").join(shuffled(full.select(F.col("node").alias("a"), F.col("shingles").alias("x"))), "a")
    both = left.join(shuffled(full.select(F.col("node").alias("b"), F.col("shingles").alias("y"))), "b").select("a", "b", "x", "y")

    def compare(batches):
        times, over = SIMILAR
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(over * shared >= times * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    similar = written(both.mapInArrow(compare, "a long, b long"), "similar")
    for done in (pairs, wanted, full):
        drop_written(done)
    return similar


def _can_be_similar(one: str, other: str) -> Column:
    """Whether sizes and places of a first common shingle allow it: what follows in both is all that they can share."""
    times, over = SIMILAR
    m, n = F.col(f"{one}.size"), F.col(f"{other}.size")
    share = F.least(m - F.col(f"{one}.pos"), n - F.col(f"{other}.pos"))
    return (F.least(m, n) * over >= F.greatest(m, n) * times) & (share * (over + times) >= (m + n) * times)


def _with_parts(live: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings of lists that hold several of the components ``parts``, with each node's own, ``part``, and those lists.

    ``most`` is the component of most in a list, ``centre`` its posting of the earliest place.
    """
    own = live.join(shuffled(parts.withColumnRenamed("node", "of")), F.col("node") == F.col("of"), "left").select("key", "node", "size", "pos", F.coalesce("component", "node").alias("part"))
    own = written(own, "postings")
    groups = own.groupBy("key", "part").agg(F.count("*").alias("n"), F.min(F.struct("pos", "node", "size")).alias("centre"))
    lists = groups.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max_by(F.struct("part", "centre"), F.struct("n", "part")).alias("m"))
    lists = written(lists.where("parts > 1").select("key", "n", F.col("m.part").alias("most"), F.col("m.centre").alias("centre")), "lists")
    return own, lists


def _to_centres(own: DataFrame, lists: DataFrame) -> DataFrame:
    """``a, b``: every node that is apart from the component of most somewhere, and the centre of the largest such list."""
    apart = own.join(shuffled(lists), "key").where("part <> most").withColumn("own", F.struct("pos", "node", "size")).where(_can_be_similar("own", "centre"))
    return apart.groupBy("node").agg(F.max_by("centre.node", F.struct("n", "key")).alias("c")).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))


def _merged(live: DataFrame) -> DataFrame:
    """The postings with lists of nearly the same nodes made one, at the earliest place of each node: no pair is lost.

    Documents with a passage in common meet at every shingle of it, which would give the same pairs over and over. Lists are
    nearly the same when two hashes have their least values at the same nodes, as happens in the measure that lists overlap.
    """
    one, other = F.xxhash64("node"), F.xxhash64("node", F.lit(SEED))
    alike = live.groupBy("key").agg(F.xxhash64(F.min(one), F.min(other)).alias("list"))
    once = live.join(shuffled(alike), "key").groupBy("list", "node", "size").agg(F.min("pos").alias("pos"))
    merged = written(once.withColumnRenamed("list", "key"), "merged")
    drop_written(live)
    return merged


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """``a, b``: nodes that SimHash links: each with the first of its fingerprint, and the firsts of linked fingerprints."""
    firsts = written(sets.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), "firsts")
    alike = sets.select("node", "fp").join(shuffled(firsts.where("first < last").select("fp", "first")), "fp").where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.links(firsts.select("fp"))  # a pair may come more than once
    one, other = firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), firsts.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    across = near.join(shuffled(one), "a").join(shuffled(other), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return alike.unionAll(across)


def _joined(parts: DataFrame | None, found: DataFrame) -> DataFrame:
    """``node, component``: the components ``parts``, if there are any yet, joined by the links ``found``."""
    links = found if parts is None else parts.toDF("a", "b").unionAll(found)
    return written(connected_components(links, "a", "b"), "parts")


def components(docs: DataFrame, sets: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``node, component`` of all nodes of ``sets`` that are similar to another."""
    postings = sets.select("node", "size", F.posexplode("prefix").alias("pos", "key"))
    shared = postings.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    live = _merged(written(postings.join(shuffled(shared), "key", "left_semi").distinct(), "live"))
    parts = _joined(None, _similar(docs, sets, _by_fingerprint(sets), words))
    parts = _joined(parts, _similar(docs, sets, _to_centres(*_with_parts(live, parts)), words))
    own, lists = _with_parts(live, parts)
    rest = own.join(shuffled(lists.select("key", "most")), "key")
    x, y = rest.where("part <> most").alias("x"), rest.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") != F.col("y.part")) & _can_be_similar("x", "y")
    left = x.join(shuffled(y), apart).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return _joined(parts, _similar(docs, sets, left, words))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the least ``doc_id`` that can be reached over documents with similarity ``SIMILAR`` or more, whether
    SimHash or the join brought them together. A null text counts as empty. Repeated rows each give a row. A null ``doc_id`` is kept and never names a component
    unless the whole component has none. An empty table gives an empty result.
    """
    members = _members(docs, words)
    named = written(members.groupBy("component").agg(F.min("doc_id").alias("component_id")), "named")
    return members.join(shuffled(named), "component").select("doc_id", "component_id")


def _members(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_hash, component`` of every row."""
    sets = set_table(docs, words)
    linked = components(docs, sets, words).withColumnRenamed("node", "of")
    ids = sets.select("doc_id", "text_hash", "node").join(shuffled(linked), F.col("node") == F.col("of"), "left")
    members = written(ids.select("doc_id", "text_hash", F.coalesce("component", "node").alias("component")), "members")
    drop_written(sets)
    return members


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` without the near duplicates: one row of every component stays.

    It is the row with the least ``doc_id`` that is not null; of rows that share it, or of a component without ids, the one with
    the least hash of its text, and of rows that repeat both any one.
    """
    members = _members(docs, SHINGLE_WORDS)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("the_id"), "text_hash")
    stays = members.groupBy("component").agg(F.min(order).alias("least")).select("least.*")
    own = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("the_id"), F.xxhash64(text_of()).alias("text_hash")]
    at = ["no_id", "the_id", "text_hash"]
    kept = with_row(docs, *own).join(shuffled(stays), at, "left_semi").dropDuplicates(at)
    return kept.select(*row_columns(kept))
