"""Conversation structure repair: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

Rows are symbols (role initial, truncated or not, or to be deleted), and the roles that are allowed are an automaton of four
places. Read from its last row backwards, a conversation is scanned by the determinised weighted automaton: its states are
vectors of the cost to go from each place, less their least, and they come into a table the first time that they are met, with
what each symbol makes of them and the weight taken off. The costs of a conversation are then one table look-up a row. The audit is
traced the other way, from the first row, over arcs that are tight, that is on a cheapest way; of several tight arcs the
one with the least letter is taken, and every letter leads to one place only, so the audit is the least in ASCII order.

Rows of a conversation come to a task sorted, and are streamed: first symbols alone, to the audit, then the texts behind the audit,
into the hash of the repaired conversation. A task never holds the texts of a conversation. Equal rows are merged and
counted before they move, and what was seen earlier is found by an aggregate and a join whose key has the turn in it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
INFINITE = 1 << 30
#: Places of ``(s?(ua)+)?``: start, after s, after u, after a. What each of s, u, a leads to (-1: nothing), and which role is due there.
STEPS = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
DUE = ("u", "u", "a", "u")
NEXT = tuple(STEPS[DUE[p]][p] for p in range(4))
ENDS = (True, False, False, True)
ROLES = {"u": "user", "a": "assistant"}
#: Symbols: twice the index in ``sua-`` and one more for a truncated row; the last one has to be deleted.
INITIALS = "sua-"
GONE = 2 * len(INITIALS)
LEGAL = {(0, 1), (1, 2), (2, 1)}
WHITE = " \t\n\x0b\x0c\r"


def _closed(raw: list[int]) -> list[int]:
    """Costs to go when rows may be inserted first. Going round twice is never cheaper, so two steps suffice."""
    once = [min(raw[p], INSERT + raw[NEXT[p]]) for p in range(4)]
    return [min(once[p], INSERT + once[NEXT[p]]) for p in range(4)]


def _arcs(symbol: int, place: int) -> list[tuple[str, int, int]]:
    """``letter, cost, next place`` of the edits that use up a row of ``symbol``."""
    found = [("D", DELETE, place)]
    if symbol != GONE:
        extra = TRUNCATED * (symbol & 1)
        after = STEPS.get(INITIALS[symbol >> 1], (-1,) * 4)[place]
        found += [("K", KEEP + extra, after)] * (after >= 0) + [("R", REROLE + extra, NEXT[place])]
    return found


class CostAutomaton:
    """The determinised automaton, built as far as conversations ask for it."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[int, tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, self.end_weight = self._state(_closed([0 if e else INFINITE for e in ENDS]))

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The number of the vector of ``costs`` less their least, and that least."""
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def before(self, state: int, symbol: int) -> tuple[int, int]:
        """The state before a row of ``symbol`` behind which ``state`` holds, and the weight."""
        at = state * (GONE + 1) + symbol
        if at not in self.table:
            to_go = self.vectors[state]
            self.table[at] = self._state(_closed([min(c + to_go[q] for _, c, q in _arcs(symbol, p)) for p in range(4)]))
        return self.table[at]

    def _trace(self, after: int, symbol: int, place: int) -> tuple[str, int]:
        """The least letters up to and with the row's own, and the place behind it."""
        at = (after, symbol, place)
        if at not in self.traces:
            state, weight = self.before(after, symbol)
            here, behind, letters = self.vectors[state], self.vectors[after], ""
            while not letters or letters[-1] == "I":
                tight = [(x, q) for x, c, q in _arcs(symbol, place) if here[place] + weight == c + behind[q]]
                if here[place] == INSERT + here[NEXT[place]]:
                    tight.append(("I", NEXT[place]))
                letter, place = min(tight)
                letters += letter
            self.traces[at] = letters, place
        return self.traces[at]

    def solve(self, symbols: bytearray) -> tuple[int, str]:
        """The least cost of repairing ``symbols``, and the least audit with that cost."""
        state, cost = self.end, self.end_weight
        states = array("I", [state])
        for symbol in reversed(symbols):
            state, weight = self.before(state, symbol)
            cost += weight
            states.append(state)
        place, letters = 0, []
        cost += self.vectors[state][place]
        for k, symbol in enumerate(symbols):
            some, place = self._trace(states[len(symbols) - 1 - k], symbol, place)
            letters.append(some)
        while not ENDS[place]:
            letters.append("I")
            place = NEXT[place]
        return cost, "".join(letters)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present`` of ``conversations`` with every kind of fault, by a hash of id and turn.

    Rows that are dropped stay with ``present`` false, so no conversation gets lost. A null role or text is one space.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"), F.explode(F.array_repeat(F.lit(True), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def _flagged(rows: DataFrame) -> DataFrame:
    """Rows merged where they are equal (``times``), with a digest of the text, and ``first``: not seen at an earlier turn."""
    merged = rows.groupBy("conv_id", "turn", "role", "text", "present").agg(F.count("*").alias("times"))
    merged = merged.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = merged.where("present").groupBy("conv_id", "role", "digest").agg(F.min(when).alias("w"))
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("w.turn").alias("t"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t"))
    return merged.join(seen, same, "left").select("conv_id", "turn", "role", "text", "present", "times", "digest", F.col("d").isNotNull().alias("first"))


def _symbol() -> tuple[Column, Column]:
    """The symbol of a row that was not seen before, and whether it is blank."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return kind * 2 + (~F.right(bare, F.lit(1)).isin(".", "!", "?")).cast("int"), bare == ""


AUDITED = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in order, one row of ``AUDITED`` each; a conversation is held as one byte and one state a row."""
    automaton = CostAutomaton()
    found: list[tuple] = []
    held, schema = 0, None
    own: tuple = ()
    current, symbols = None, bytearray()
    turns, low, high, last_turn = 0, None, None, None
    blank = duplicate = truncated = illegal = 0
    last = -1

    def finish() -> None:
        nonlocal held
        cost, audit = automaton.solve(symbols)
        gaps = high - low + 1 - turns if turns else 0
        found.append((*own, gaps, blank, duplicate, truncated, illegal, cost, audit))
        held += 64 + len(audit)

    def out() -> pa.RecordBatch:
        nonlocal found, held
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        kinds = [schema.field("conv_id").type, *[pa.int64()] * 6, pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kinds[k]) for k in range(8)], names=names)
        found, held = [], 0
        return made

    for batch in batches:
        schema = batch.schema
        for conv, turn, present, times, first, symbol, is_blank in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "present", "times", "first", "symbol", "blank")]):
            if own != (conv,):
                if own:
                    finish()
                    if held > 1 << 20:
                        yield out()
                own, symbols = (conv,), bytearray()
                turns, low, high, last_turn = 0, None, None, None
                blank = duplicate = truncated = illegal = 0
                last = -1
            if not present:
                continue
            if turn is not None and turn != last_turn:
                turns += 1
                low = turn if low is None else low
                high = last_turn = turn
            kind = symbol >> 1
            illegal += (last >= 0 and (last, kind) not in LEGAL) + (times - 1) * ((kind, kind) not in LEGAL)
            last = kind
            if is_blank:
                blank += times
                symbols += bytes([GONE]) * times
            else:
                duplicate += times - first
                truncated += first and symbol & 1
                symbols += bytes([symbol] * first) + bytes([GONE]) * (times - first)
    if own:
        finish()
    if found:
        yield out()


class _Repaired:
    """The hash of one repaired conversation, its rows given in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place, self.hash, self.any = audit, 0, 0, hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.hash.update(("\n" * self.any + role + ":" + text).encode("utf-8"))
        self.any = True

    def _due(self, text: str) -> None:
        self._say(ROLES[DUE[self.place]], text)
        self.place = NEXT[self.place]

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._due("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._say(role, text)
            self.place = STEPS[role[0]][self.place]
        elif letter == "R":
            self._due(text)

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``AUDITED`` with ``repaired_sha256``: every one comes before the rows of its conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    head, repaired = None, None
    for batch in batches:
        heads, hashes = [], []
        columns = [batch.column(c).to_pylist() for c in ("is_row", "role", "text", "times")]
        for k, (is_row, role, text, times) in enumerate(zip(*columns)):
            if is_row:
                for _ in range(times):
                    repaired.row(role, text)
                continue
            if head is not None:
                heads.append(head)
                hashes.append(repaired.digest())
            head, repaired = batch.select(names).slice(k, 1), _Repaired(batch.column("audit")[k].as_py())
        if heads:
            yield from _with_hashes(heads, hashes)
    if head is not None:
        yield from _with_hashes([head], [repaired.digest()])


def _with_hashes(heads: list[pa.RecordBatch], hashes: list[str]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_batches(heads).combine_chunks().append_column("repaired_sha256", pa.array(hashes, pa.string())).to_batches()


def repair(rows: DataFrame) -> DataFrame:
    """One row for every ``conv_id`` of ``rows`` (``conv_id, turn, role, text``): its faults, and its cheapest repair.

    ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` are longs, ``audit`` has the initials of the edits (Keep,
    Rerole, Delete, Insert) and ``repaired_sha256`` the hash of the repaired ``role:text`` lines. Rows with a ``present`` that is false name
    their conversation only. Rows count in the order of turn (null first), role and the SHA-256 of the text; a null role or text counts
    as one space, a null ``conv_id`` is a conversation like any other. Rows that repeat everything are duplicates. Other columns are not read. An empty
    table gives an empty result. A conversation without rows has zeros, an empty audit and the hash of an empty string.
    """
    there = F.coalesce("present", F.lit(True)) if "present" in rows.columns else F.lit(True)
    spaces = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    flagged = written(_flagged(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *spaces, there.alias("present"))), "flagged")
    symbol, blank = _symbol()
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    short = flagged.select("conv_id", "turn", F.col("role"), "digest", "present", F.col("times"), "first", symbol.alias("symbol"), blank.alias("blank"))
    kind = flagged.schema["conv_id"].dataType.simpleString()
    audits = short.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_audits, AUDITED.format(id=kind))
    audits = written(audits, "audits")
    heads = audits.withColumn("is_row", F.lit(False))
    both = heads.unionByName(flagged.where("present").select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "digest", "text", "times"), allowMissingColumns=True)
    order.insert(1, F.col("is_row"))
    hashed = both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_hashes, AUDITED.format(id=kind) + ", repaired_sha256 string")
    result = written(hashed, "repaired")
    drop_written(flagged)
    drop_written(audits)
    return result
