"""Best-fit packing of token sequences by bin completion.

Documents are tokenized where they lie and leave only the places, lengths and checksums of their pieces. Whole
pieces are sequences of their own. The others are dealt evenly into groups of bounded size, and every group is packed
by branch and bound: the largest piece left opens a sequence, the undominated fillings of the rest of it, of any number
of pieces and least waste first, are the branches, a branch that wastes more than the incumbent allows is pruned, and
the best-fit packing is the first incumbent. The search ends when the incumbent meets the bound or nothing is left to
try, which proves it least, or after a stated number of fillings looked at.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_of, written

SEQUENCE_TOKENS = 2048
#: Closes every document.
END_ID = 0
#: Pieces that one task packs together.
GROUP_PIECES = 4096
#: Fillings that the search of one group may look at before the incumbent stands unproved: the only limit of the search.
SEARCH_STEPS = 20_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """Text to ids, as ``tokenizers`` gives them for a byte-level BPE vocabulary.

    Where the same vocabulary lies beside it as ranks, ``tiktoken`` computes the same ids in a quarter of the
    time; texts that hold the name of an added token are left to ``tokenizers``.
    """
    import base64
    import os

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary)
    added = [t.content for t in own.get_added_tokens_decoder().values()]
    ranks_file = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_file):
        return lambda text: own.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if any(name in text for name in added):
            return own.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    ids = _encoder(vocabulary)(text)
    ids.append(END_ID)
    return np.array(ids, "<u4")


def cuts(length: int, size: int = SEQUENCE_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only a longer document is cut, and only its first piece may be shorter than ``size``."""
    if length <= size:
        return [(0, length)]
    first = length % size
    starts = ([0] if first else []) + list(range(first, length, size))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


def pieces(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, with ``with_ids`` also ``ids``, of every document."""
    vocabulary = vocabulary or default_vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def of(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py(), vocabulary)
                for k, (start, length) in enumerate(cuts(len(ids), size)):
                    part = ids[start : start + length]
                    row = [doc, k, start, length, zlib.crc32(part.tobytes())] + ([part.tolist()] if with_ids else [])
                    for column, value in zip(out, row):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(of, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each size goes where the least room is left after it."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for size in sorted(sizes, reverse=True):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(size)
        insort(rooms, (room - size, b))
    return bins


def _sums_of(sizes: list[int], counts: dict[int, int], gap: int) -> list[int]:
    """For each k, the sums up to ``gap`` that the k smallest sizes can make, as the bits of one number."""
    every = (1 << (gap + 1)) - 1
    out = [1]
    for s in sizes:
        sums, many, step = out[-1], min(counts[s], gap // s), 1
        while many > 0:  # steps of 1, 2, 4, ... make up any number of the size
            step = min(step, many)
            sums |= (sums << (s * step)) & every
            many -= step
            step *= 2
        out.append(sums)
    return out


def _makes(sizes: list[int], counts: dict[int, int], sums: list[int], total: int) -> Iterator[tuple[int, ...]]:
    """Every choice of pieces with exactly the sum ``total``, those with larger sizes first."""
    stack = [(len(sizes), total, ())]
    while stack:
        k, rest, taken = stack.pop()
        if rest == 0:
            yield taken
            continue
        s = sizes[k - 1]
        for many in range(min(counts[s], rest // s) + 1):
            if sums[k - 1] >> (rest - many * s) & 1:
                stack.append((k - 1, rest - many * s, taken + (s,) * many))


def fillings(gap: int, left: list[int], counts: dict[int, int], spare: int) -> Iterator[tuple[int, ...] | None]:
    """Undominated fillings of ``gap`` that waste at most ``spare``, with the sizes that are left (ascending), least waste first.

    None stands for each one that is dominated, so that a search can count what it looks at.

    A filling is dominated by one that has a piece left over, x, in place of some of its own whose sum x is not below: what
    that one leaves fits wherever x would. So is one with room for another piece. Replaced are one, two or three pieces,
    which leaves some dominated ones in: that costs effort and loses nothing.
    """
    sizes = left[: bisect_right(left, gap)]
    return _fillings(gap, sizes, {s: counts[s] for s in sizes}, spare)


def _fillings(gap: int, sizes: list[int], counts: dict[int, int], spare: int) -> Iterator[tuple[int, ...] | None]:
    sums = _sums_of(sizes, counts, gap)
    for waste in range(min(spare, gap) + 1):
        if not sums[-1] >> (gap - waste) & 1:
            continue
        for filling in _makes(sizes, counts, sums, gap - waste):
            over = [s for s in sizes if counts[s] > filling.count(s)]
            if over and over[0] <= waste:
                yield None
                continue
            replaced = {sum(c) + 1 for c in combinations(filling, 1)} | {sum(c) for n in (2, 3) for c in set(combinations(filling, n))}
            low = {r: bisect_left(over, r) for r in replaced}
            single = {s + 1 for s in filling}
            if any(at < len(over) and over[at] <= (r - 1 if r in single else r) + waste for r, at in low.items()):
                yield None
                continue
            yield filling


def fewest(sizes: list[int], capacity: int) -> int:
    """A number of bins that no packing can do without.

    For any k up to half the capacity: sizes above half a bin have one each, and what the sizes from k to half a bin hold
    beyond the room beside those of them that leave k or more needs further bins.
    """
    ordered = np.sort(np.asarray(sizes, np.int64))
    held = np.concatenate([[0], np.cumsum(ordered)])
    k = np.arange(0, capacity // 2 + 1)
    half = np.searchsorted(ordered, capacity // 2, "right")
    large = np.searchsorted(ordered, capacity - k, "right")
    small = np.searchsorted(ordered, k, "left")
    room = (large - half) * capacity - (held[large] - held[half])
    beyond = np.maximum(0, held[half] - held[np.minimum(small, half)] - room)
    return int((len(ordered) - half + -(-beyond // capacity)).max(initial=0))


def search(sizes: list[int], capacity: int = SEQUENCE_TOKENS, steps: int = SEARCH_STEPS) -> tuple[list[list[int]], bool]:
    """Sizes (each from 1 to ``capacity``) in bins of ``capacity``, and whether there is a proof that no fewer will do."""
    incumbent = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = fewest(sizes, capacity)
    if len(incumbent) <= bound:
        return incumbent, True
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    left = sorted(counts)
    packed: list[tuple[int, ...]] = []
    waste = 0

    def take(filling: tuple[int, ...], sign: int) -> None:
        for s in filling:
            counts[s] = counts.get(s, 0) - sign
            if sign > 0 and not counts[s]:
                left.pop(bisect_left(left, s))
            elif sign < 0 and counts[s] == 1:
                insort(left, s)

    def open_next() -> Iterator[tuple[int, ...] | None]:
        """Fillings of the sequence that the largest size opens; made one by one, as the search comes back for them."""
        first = left[-1]
        take((first,), 1)
        found = fillings(capacity - first, left, counts, (len(incumbent) - 1) * capacity - total - waste)
        take((first,), -1)
        return (None if f is None else (first, *f) for f in found)

    stack = [open_next()]
    while stack and steps > 0 and len(incumbent) > bound:
        steps -= 1
        filling = next(stack[-1], ())
        if filling is None:
            continue
        spare = capacity - sum(filling)
        if not filling or waste + spare > (len(incumbent) - 1) * capacity - total:
            stack.pop()  # those that follow waste no less
            if packed:
                last = packed.pop()
                take(last, -1)
                waste -= capacity - sum(last)
            continue
        take(filling, 1)
        packed.append(filling)
        waste += spare
        if left:
            stack.append(open_next())
            continue
        incumbent = [list(f) for f in packed]
        take(packed.pop(), -1)
        waste -= spare
    return incumbent, not stack or len(incumbent) <= bound


def bin_completion(sizes: list[int], capacity: int = SEQUENCE_TOKENS, steps: int = SEARCH_STEPS) -> list[list[int]]:
    """Sizes (each from 1 to ``capacity``) in as few bins of ``capacity`` as the search finds."""
    return search(sizes, capacity, steps)[0]


def _pack_group(group: pd.DataFrame, size: int) -> pd.DataFrame:
    waiting: dict[int, list[int]] = {}
    for at, length in enumerate(group["length"].tolist()):
        waiting.setdefault(length, []).append(at)
    sequence = np.zeros(len(group), np.int64)
    offset = np.zeros(len(group), np.int64)
    bins, proved = search(group["length"].tolist(), size)
    for k, filling in enumerate(bins):
        place = 0
        for length in filling:
            at = waiting[length].pop()
            sequence[at], offset[at] = k, place
            place += length
    out = group.drop(columns=["grp", "nth"])
    return out.assign(sequence_id=sequence + (group["grp"].to_numpy() << 32), offset=offset, proved=proved)


def pack(pieces_table: DataFrame, size: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The columns of a stored table of pieces, and ``sequence_id, offset, proved``.

    The pieces (``length`` from 1 to ``size``) fill sequences without gaps from offset 0. Groups are dealt by row number
    and not by any column, so repeated ids cannot crowd one. ``proved``: no packing of the piece's group has fewer sequences.
    """
    numbered = pieces_table.withColumn("nth", F.monotonically_increasing_id())
    whole = numbered.where(F.col("length") == size).withColumn("sequence_id", -1 - F.col("nth")).withColumn("offset", F.lit(0).cast("long")).withColumn("proved", F.lit(True)).drop("nth")
    parts = numbered.where(F.col("length") < size)
    groups = max(1, -(-pieces_table.where(F.col("length") < size).count() // group_pieces))
    dealt = parts.withColumn("grp", F.pmod(F.xxhash64("nth"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    packed = dealt.groupBy("grp").applyInPandas(lambda g: _pack_group(g, size), schema)
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset, proved`` (and ``ids``) of every document's pieces.

    A document is its text's token ids and a closing 0; a null text is empty and so has the closing 0 alone. Repeated
    rows and a null ``doc_id`` are packed like others; an empty table gives an empty result.
    """
    return pack(written(pieces(docs, vocabulary, size, with_ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token sequences themselves, from a packing ``with_ids``."""
    placed = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return placed.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
