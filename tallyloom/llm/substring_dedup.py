"""Substring dedup by sliding sentence spans: runs of sentences that occurred before are removed.

Every run of consecutive sentences is hashed to 128 bits and grouped over the whole corpus. The first occurrence of a
run, by ``doc_id``, text hash and place, stays; the sentences of all others are cut out of their documents. A sentence
ends at a terminator before white space, or at a line's end. A long one is cut after every word whose hash is the least
among its neighbours, so a passage that was put in the middle of a sentence falls into the same units in every
document, but for a few words at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, text_of, with_row, written

#: A run is so many sentences, and goes on until it has so many words: any passage of fifty words holds one.
RUN_SENTENCES = 3
RUN_WORDS = 25
#: A longer sentence is cut after words whose hash is the least among so many neighbours on either side.
SENTENCE_WORDS = 12
NEIGHBOURS = 2
#: Runs that leave a task as one batch, and characters of texts that are cut into units together.
RUN_BATCH, TOGETHER = 50_000, 1 << 19

#: A sentence ends after these even where no white space follows.
_WIDE = "。！？"
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
_ROLL = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_HALF = np.uint64(32)
_ENDS = (bytes(8), b"\1".rjust(8, b"\0"))


class _Words(dict):
    """Two hashes of each word and whether it ends a sentence, as 24 bytes."""

    def __init__(self) -> None:
        import xxhash

        super().__init__()
        self.digest = xxhash.xxh3_64_digest

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        own = word.encode("utf-8")
        found = self[word] = self.digest(own) + self.digest(own, 1) + _ENDS[word[-1] in ".!?"]
        return found


class Units(NamedTuple):
    """The units of some texts, in order, by the words of all these texts."""

    words: np.ndarray  # a row for each: two hashes, whether it ends a sentence
    first: np.ndarray  # the word that a unit begins with
    size: np.ndarray  # how many words it has
    split: np.ndarray  # whether it is a part of a long sentence
    ends: np.ndarray  # words up to each unit's end
    stop: np.ndarray  # the unit after the last of its text
    text: np.ndarray  # the text's number

    def last_of_run(self, at: np.ndarray) -> np.ndarray:
        """The last unit of the run that begins at each of ``at``; ``stop`` or more if what is left is too short for one."""
        return np.maximum(np.searchsorted(self.ends, self.ends[at] - self.size[at] + RUN_WORDS), at + RUN_SENTENCES - 1)


def units(texts: list[str], known: _Words) -> Units:
    """Where a long sentence is cut depends on the words near by, not on how many come before."""
    words: list[str] = []
    lines, until = [], []
    for text in texts:
        if not text.isascii():
            for c in _WIDE:
                text = text.replace(c, c + "\n")
        for line in text.split("\n"):
            words += line.split()
            lines.append(len(words))
        until.append(len(words))
    found = np.frombuffer(b"".join(map(known.__getitem__, words)), ">u8").astype(np.uint64).reshape(-1, 3)
    last = found[:, 2] != 0
    lines = np.array(lines, np.int64)
    last[lines[lines > 0] - 1] = True
    stops = np.flatnonzero(last)
    sizes = np.diff(stops, prepend=-1)
    sentence, long = np.repeat(np.arange(len(stops)), sizes), np.repeat(sizes > SENTENCE_WORDS, sizes)
    hashes = found[:, 0].copy()
    least = hashes.copy()
    for k in range(1, NEIGHBOURS + 1):
        same = sentence[k:] == sentence[:-k]
        np.minimum(least[k:], hashes[:-k], out=least[k:], where=same)
        np.minimum(least[:-k], hashes[k:], out=least[:-k], where=same)
    ends = np.flatnonzero(last | (long & (least == hashes))) + 1
    size = np.diff(ends, prepend=0)
    text = np.searchsorted(np.array(until, np.int64), ends - size, side="right")
    return Units(found, ends - size, size, long[ends - 1], ends, np.searchsorted(text, text, side="right"), text)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> _HALF)) * _MIX
    return hashes ^ (hashes >> _HALF)


def _rolled(values: np.ndarray, first: np.ndarray, size: np.ndarray, roll: np.uint64) -> np.ndarray:
    """One hash for each stretch of ``values``, of its values in order and their number."""
    out = np.zeros(len(first), np.uint64)
    on, k = np.arange(len(first)), 0
    while len(on := on[size[on] > k]):
        out[on] = out[on] * roll + values[first[on] + k]
        k += 1
    return _mixed(out + size.astype(np.uint64) * _MIX)


def runs(texts: list[str], known: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, first unit, 128-bit hash as two halves) of every run."""
    found = units(texts, known)
    at = np.arange(len(found.first))
    last = found.last_of_run(at)
    at, last = at[last < found.stop], last[last < found.stop]
    halves = []
    for lane, roll in enumerate(_ROLL):
        own = _rolled(found.words[:, lane], found.first, found.size, roll)
        halves.append(_rolled(own, at, last - at + 1, roll))
    return found.text[at], at - np.searchsorted(found.text, found.text[at]), np.stack(halves, axis=1).view(np.int64)


def _in_parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """From where to where ``texts`` are looked at together."""
    first = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= TOGETHER:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _identity() -> list:
    """``doc_id`` and a hash of the text: rows that share an id are told apart by it, null ids too."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash")]


def run_table(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, place, hi, lo``: one row for every run of every document."""

    def of(batches):
        known = _Words()
        for batch in batches:
            ids, hashes, texts = (batch.column(k) for k in range(3))
            texts = texts.to_pylist()
            for first, end in _in_parts(texts):
                text, place, halves = runs(texts[first:end], known)
                for k in range(0, len(text), RUN_BATCH):
                    part = slice(k, k + RUN_BATCH)
                    row = pa.array(text[part] + first)
                    columns = [ids.take(row), hashes.take(row), pa.array(place[part].astype(np.int32)), *map(pa.array, halves[part].T.copy())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "place", "hi", "lo"])

    rows = docs.select(*_identity(), text_of().alias("text"))
    return rows.mapInArrow(of, "doc_id long, text_hash long, place int, hi long, lo long")


def repeated_sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, places``: where runs begin that occurred before, for documents that have any.

    Runs are first only counted, then those that come more than once are taken out of their table. Both sides of each join come
    straight from shuffles, so Spark can split the part with a very common run over many tasks.
    """
    table = written(run_table(docs), "runs")
    several = table.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1")
    several = written(several.select("hi", "lo", F.monotonically_increasing_id().alias("run")), "several")  # a short number for each
    again = written(table.join(several, ["hi", "lo"]).select("run", "doc_id", "text_hash", "place"), "repeated")
    drop_written(table)
    drop_written(several)
    first = written(again.groupBy("run").agg(F.min(F.struct("doc_id", "text_hash", "place")).alias("first")), "first")
    later = again.join(first, "run").where(~F.struct("doc_id", "text_hash", "place").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))


def _word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = _SPACE[np.minimum(points, len(_SPACE) - 1)]
    begins, ends = ~space, ~space
    if text.isascii():
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
    else:
        wide = np.isin(points, [ord(c) for c in _WIDE])
        begins[1:] &= space[:-1] | wide[:-1]
        ends[:-1] &= space[1:] | wide[:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def cuts(texts: list[str], places: list[np.ndarray], known: _Words) -> list[tuple[str, list[dict], int]]:
    """Each text without the runs that begin at its ``places``, the spans that go, and how many words they have."""
    found = units(texts, known)
    at = np.concatenate([p + base for p, base in zip(places, np.searchsorted(found.text, np.arange(len(texts))))])
    runs_on = np.zeros(len(found.first) + 1, np.int64)
    np.add.at(runs_on, at, 1)
    np.add.at(runs_on, found.last_of_run(at) + 1, -1)
    gone = np.cumsum(runs_on)[:-1] > 0
    on = gone[1:] & gone[:-1] & (found.text[1:] == found.text[:-1])
    firsts, lasts = gone.copy(), gone.copy()
    firsts[1:] &= ~on
    lasts[:-1] &= ~on
    n_words = np.zeros(len(texts), np.int64)
    np.add.at(n_words, found.text[gone], found.size[gone])
    whole = "\n".join(texts)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)]).tolist()
    starts, ends = _word_spans(whole)

    def left(unit: int, begin: int) -> int:
        """A sentence begins where the white space after the one before ends."""
        k = found.first[unit]
        before = max(ends[k - 1], begin) if k else begin
        open_ = not found.split[unit] and "\n" not in whole[before : starts[k]] and (before == begin or whole[before - 1] in _WIDE)
        return int(before if open_ else starts[k]) - begin

    def right(unit: int, begin: int) -> int:
        k = found.ends[unit] - 1
        end = ends[k]
        gap = whole[end : starts[k + 1] if k + 1 < len(starts) else None]
        return int(end if found.split[unit] or whole[end - 1] in _WIDE + ".!?" else end + (gap.index("\n") if "\n" in gap else len(gap))) - begin

    removed: list[list[dict]] = [[] for _ in texts]
    for first, last in zip(np.flatnonzero(firsts).tolist(), np.flatnonzero(lasts).tolist()):
        text = found.text[first]
        removed[text].append({"start": left(first, begins[text]), "end": right(last, begins[text])})
    out = []
    for text, spans, n in zip(texts, removed, n_words.tolist()):
        edges = [0, *(e for s in spans for e in (s["start"], s["end"])), len(text)]
        out.append(("".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]), spans, n))
    return out


def drop_repeated_spans(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``text`` cleaned, and ``removed, n_removed_words``.

    ``removed`` lists the code-point spans of the original text that were cut, of sentences in a run of which there is
    an earlier occurrence, in this document or another. Null texts count as empty and come back empty. A text of fewer
    sentences or words than a run keeps all, copies of it too. Rows that share a ``doc_id`` but not their text are
    documents of their own; rows that repeat both are one document and come back alike. A null ``doc_id`` comes first in
    the order. An empty table gives an empty result. Input columns named like the added ones give way.
    """
    spans = repeated_sentences(docs).toDF("span_id", "span_hash", "places")
    rows = with_row(docs, *[c.alias(f"key_{n}") for n, c in zip(("id", "hash"), _identity())], text_of().alias("full_text"))
    same = F.col("key_id").eqNullSafe(F.col("span_id")) & (F.col("key_hash") == F.col("span_hash"))
    joined = rows.join(spans, same, "left")

    @F.pandas_udf("text string, removed array<struct<start:int,end:int>>, n_removed_words long")
    def cut(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        known = _Words()
        found = [(t, [], 0) for t in texts]
        rows = [k for k, p in enumerate(places) if p is not None and len(p)]
        for first, end in _in_parts([texts.iloc[k] for k in rows]):
            part = rows[first:end]
            for k, done in zip(part, cuts([texts.iloc[k] for k in part], [places.iloc[k] for k in part], known)):
                found[k] = done
        return pd.DataFrame(found, columns=["text", "removed", "n_removed_words"])

    done = joined.select("row", cut("full_text", "places").alias("cut"))
    names = [c for c in done.schema["row"].dataType.fieldNames() if c.lower() not in ("removed", "n_removed_words")]
    columns = [F.col("cut.text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in names]
    return done.select(*columns, "cut.removed", "cut.n_removed_words")
