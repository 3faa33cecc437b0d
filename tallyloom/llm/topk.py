"""Exact top-k search: the k-th best score of every query is located by global histograms, never by sorting scores.

Queries and candidates are packed into blocks, and every block of queries meets every block of candidates once a round. There all
scores are worked out, by one exact matrix product, and only counts leave the task: how many scores of a query fall into each bin of
the interval in which its k-th score lies, from the top bin down to the one where the task's own count reaches k (what lies
below cannot be the k-th of all). Summed over tasks they show the bin of the k-th score, which is the next interval, until that bin is
one number wide or ends exactly at the k-th. A last round keeps what is above, and of ties at the k-th score the least ids.

The state of a query is three numbers that travel with its block. Nothing passes through the driver but how many queries are open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, written
from tallyloom.llm.vectors import dimensions, padded, whole_vectors

K = 10
SCALE = 1024
#: Rows of a block of candidates and of queries; bins of a histogram, as bits.
CANDIDATE_ROWS, QUERY_ROWS, BIN_BITS = 2048, 1024, 11
#: Scores beyond this count as this, either sign, so that differences of scores are longs.
MOST = (1 << 62) - 1024
OWN = -(1 << 63)
PACKED = "n int, ids binary, no_id binary, m binary, norm double"


def packer(rows: int):
    """Packs ``id, v`` into blocks of at most ``rows`` rows: ids, which are null, vectors as doubles, and the largest norm."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def out(table: pa.Table) -> pa.RecordBatch:
            ids = table.column("id").combine_chunks()
            m = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            square = (m.reshape(len(ids), -1) ** 2).sum(axis=1).max(initial=0.0) if m.size else 0.0
            none = ids.is_null().to_numpy(zero_copy_only=False)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [[len(ids)], [known.tobytes()], [none.astype(np.uint8).tobytes()], [m.astype(np.float64).tobytes()], [float(np.sqrt(square))]]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, kinds)], names=["n", "ids", "no_id", "m", "norm"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= rows:
                table = pa.Table.from_batches(held)
                whole = n - n % rows
                for at in range(0, whole, rows):
                    yield out(table.slice(at, rows))
                held, n = table.slice(whole).to_batches(), n - whole
        if n:
            yield out(pa.Table.from_batches(held))

    return pack


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, held as doubles, as longs.

    Where all partial sums are below 2 ** 53 the product in doubles is exact; rows with larger entries go by Python's numbers.
    """
    dims = max(1, q.shape[1])
    limit = 2.0**53 / dims
    big_q, big_c = np.abs(q).max(axis=1, initial=0.0), np.abs(c).max(axis=1, initial=0.0)
    if big_q.max(initial=0.0) * big_c.max(initial=0.0) <= limit:
        return (q @ c.T).astype(np.int64)
    safe = np.sqrt(limit)
    fine_q, fine_c = big_q <= safe, big_c <= safe
    found = (np.where(fine_q[:, None], q, 0) @ np.where(fine_c[:, None], c, 0).T).astype(np.int64)
    for i in range(len(q)):
        for j in range(len(c)) if not fine_q[i] else np.flatnonzero(~fine_c).tolist():
            found[i, j] = max(-MOST, min(MOST, sum(int(a) * int(b) for a, b in zip(q[i].tolist(), c[j].tolist()))))
    return found


class Blocks:
    """A pair of blocks in a task: ids, and scores with those of a query's own row marked."""

    def __init__(self, row: dict) -> None:
        self.q_ids, self.c_ids = (np.frombuffer(row[k], np.int64) for k in ("q_ids", "ids"))
        self.c_null = np.frombuffer(row["no_id"], np.uint8).astype(bool)
        q, c = (np.frombuffer(row[k], np.float64) for k in ("q_m", "m"))
        self.scores = exact_products(q.reshape(len(self.q_ids), -1), c.reshape(len(self.c_ids), -1))
        order = np.argsort(self.c_ids, kind="stable")
        first, last = (np.searchsorted(self.c_ids[order], self.q_ids, side) for side in ("left", "right"))
        for i in np.flatnonzero(last > first).tolist():
            own = order[first[i] : last[i]]
            self.scores[i, own[~self.c_null[own]]] = OWN


STATE = ["low", "shift", "above", "open"]
PAIR = ["block", "q_ids", "q_m", *STATE, "ids", "no_id", "m"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield {c: batch.column(c)[i].as_buffer() if pa.types.is_binary(batch.column(c).type) else batch.column(c)[i].as_py() for c in PAIR}


def _state(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.array(row[c], np.int64) for c in STATE)


def counter(k: int, bits: int):
    """Counts scores by bin, ``block, q, bin, n``, for every query whose interval is not settled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for row in _rows(batches):
            pair = Blocks(row)
            low, shift, above, still = _state(row)
            if row["block"] not in held:
                held[row["block"]] = np.zeros((len(low), 1 << bits), np.int64), np.where(still, low, np.iinfo(np.int64).max)
            counts, floor = held[row["block"]]
            # Scores below the bin in which this task has counted k already are no k-th score of all.
            q, c = np.nonzero(pair.scores >= floor[:, None])
            bins = (pair.scores[q, c] - low[q]) >> shift[q]
            inside = bins < 1 << bits
            counts += np.bincount((q[inside] << bits) + bins[inside], minlength=counts.size).reshape(counts.shape)
            reached = above[:, None] + np.cumsum(counts[:, ::-1], axis=1) >= k
            at = np.where(reached.any(axis=1), counts.shape[1] - 1 - reached.argmax(axis=1), 0)
            np.copyto(floor, low + (at << shift), where=still > 0)
            np.copyto(counts, 0, where=np.arange(counts.shape[1]) < at[:, None])
        for block, (counts, _) in held.items():
            q, b = np.nonzero(counts)
            columns = [pa.array(np.full(len(q), block, np.int64)), pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "q", "bin", "n"])

    return count


def chooser(k: int):
    """``query_id, vec_id, score, block, q``: scores above a query's k-th one, and of ties there the least ids of the task."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pair = Blocks(row)
            low = _state(row)[0]
            q, c = np.nonzero(pair.scores >= low[:, None])
            score, none, ids = pair.scores[q, c], pair.c_null[c], pair.c_ids[c]
            order = np.lexsort((ids, none, -score, q))
            first = np.searchsorted(q[order], np.arange(len(low)))
            order = order[np.arange(len(order)) - first[q[order]] < k]
            q = q[order]
            columns = [
                pa.array(pair.q_ids[q]), pa.array(ids[order], pa.int64(), mask=none[order]), pa.array(score[order]),
                pa.array(np.full(len(q), row["block"], np.int64)), pa.array(q.astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "block", "q"])

    return choose


def _located(counts: DataFrame, queries: DataFrame, k: int, bits: int) -> DataFrame:
    """``queries`` with the interval of each one's k-th score narrowed to a bin."""
    down = Window.partitionBy("block", "q").orderBy(F.desc("bin"))
    summed = counts.groupBy("block", "q", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
    state = queries.select("block", F.posexplode(F.arrays_zip(*STATE)).alias("q", "s")).select("block", "q", "s.*")
    known = state.join(summed, ["block", "q"], "left")
    reached = F.col("open") & (F.col("above") + F.col("upto") >= k)
    hit = F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("over"), F.col("n").alias("inside")), F.when(reached, F.col("bin")))
    found = known.groupBy("block", "q", "low", "shift", "above").agg(hit.alias("hit"), F.max(F.when(reached, F.col("bin"))).alias("any"))
    # Settled before, or fewer than k scores in all: everything from the bottom of the interval on is wanted.
    low = F.when(F.col("any").isNull(), F.col("low")).otherwise(F.col("low") + F.call_function("shiftleft", F.col("hit.bin").cast("long"), F.col("shift").cast("int")))
    over = F.when(F.col("any").isNull(), F.col("above")).otherwise(F.col("above") + F.col("hit.over"))
    settled = F.col("any").isNull() | (F.col("shift") == 0) | (over + F.col("hit.inside") == k)
    step = F.when(settled, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("shift") - bits))
    rows = found.select("block", F.struct("q", low.alias("low"), step.cast("long").alias("shift"), over.alias("above"), (~settled).alias("open")).alias("s"))
    packed = rows.groupBy("block").agg(F.array_sort(F.collect_list("s")).alias("s"))
    kept = queries.select("block", "q_ids", "q_m").join(packed, "block")
    return kept.select("block", "q_ids", "q_m", *[F.col(f"s.{c}").alias(c) for c in STATE])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, bits: int = BIN_BITS, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates of the highest inner product of every query, fewer if there are fewer.

    ``queries`` and ``candidates`` have ``id`` and ``v``, whole numbers as doubles, shorter vectors filled up with zeros to one length. A candidate with
    the query's id is its own row and does not count. Ties go to the smaller id, a null id last. Repeated candidates each count; a repeated
    query gives its rows again. Scores beyond ``MOST`` count as it. Empty tables give an empty result.
    """
    # Round robin, as vectors and ids may be the same in a third of all rows.
    parts = max(1, -(-candidates.count() // candidate_rows), candidates.sparkSession.sparkContext.defaultParallelism)
    c_blocks = written(candidates.repartition(parts).mapInArrow(packer(candidate_rows), PACKED), "candidates")
    q_parts = max(1, -(-queries.count() // query_rows))
    q_blocks = queries.where("id IS NOT NULL").repartition(q_parts).mapInArrow(packer(query_rows), PACKED)
    most = c_blocks.agg(F.max("norm")).first()[0] or 0.0
    reach = F.least(F.lit(float(MOST)), F.col("norm") * most * (1 + 1e-12) + 1).cast("long")
    wide = F.length(F.conv(F.hex(reach * 2), 16, 2)) - bits
    per_query = [F.array_repeat(x, F.col("n")).alias(name) for x, name in ((-reach, "low"), (F.greatest(F.lit(0), wide).cast("long"), "shift"), (F.lit(0).cast("long"), "above"), (F.lit(True), "open"))]
    state = written(q_blocks.select(F.monotonically_increasing_id().alias("block"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), *per_query), "queries")
    blocks = c_blocks.select("ids", "no_id", "m")

    def pairs(some: DataFrame) -> DataFrame:
        # Blocks, not rows: their number is the product of two small numbers, and each pair is a matrix product.
        return blocks.crossJoin(some).select(*PAIR)

    while True:
        unsettled = state.where(F.exists("open", lambda o: o))
        if not unsettled.count():
            break
        counts = written(pairs(unsettled).mapInArrow(counter(k, bits), "block long, q int, bin int, n long"), "counts")
        narrowed = written(_located(counts, unsettled, k, bits).unionByName(state.where(~F.exists("open", lambda o: o))), "queries")
        drop_written(counts)
        drop_written(state)
        state = narrowed
    best = pairs(state).mapInArrow(chooser(k), "query_id long, vec_id long, score long, block long, q int")
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    result = written(ranked, "best")
    drop_written(c_blocks)
    drop_written(state)
    return result


def search_embeddings(rows: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """The ``k`` best rows (``vec_id``) of ``rows`` for each of its rows whose ``vec_id`` is divisible by ``every``.

    Entries x become floor(1024 * x). Rows with a null vector, or null or non-finite entries, take no part; a null ``vec_id`` is a candidate
    and never a query. Other columns are not read.
    """
    vectors = whole_vectors(rows, "vec_id", "embedding")
    dims = dimensions(vectors)
    largest = F.lit(1.7976931348623157e308)
    entries = F.transform("v", lambda x: F.greatest(-largest, F.least(largest, F.when(F.abs(x) < 2.0**52, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))))
    whole = vectors.select("id", padded(entries, dims, F.lit(0.0)).alias("v"))
    return top_k(whole.where(F.col("id") % every == 0), whole, k)
