import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def best(rows, faults):
    """All sequences of edits by exhaustive search over costs, least cost and then least string."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    seen = {}
    todo = [(0, "", 0, 0, ())]
    import heapq

    while todo:
        cost, audit, i, place, made = heapq.heappop(todo)
        if (i, place) in seen:
            continue
        seen[i, place] = 1
        if i == len(rows) and place in (0, 3):
            return cost, audit, made
        due = "a" if place == 2 else "u"
        full = {"u": "user", "a": "assistant"}[due]
        heapq.heappush(todo, (cost + 5, audit + "I", i, step[place, due], (*made, f"{full}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(todo, (cost + 2, audit + "D", i + 1, place, made))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if (place, role[:1]) in step:
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, step[place, role[:1]], (*made, f"{role}:{text}")))
                heapq.heappush(todo, (cost + 1 + more, audit + "R", i + 1, step[place, due], (*made, f"{full}:{text}")))


def expected(original):
    out = []
    for conv in dict.fromkeys(r[0] for r in original):
        rows = [r for r in damage(original) if r[0] == conv]
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in rows:
            bare = text.rstrip(WS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, made = best([(r[2], r[3]) for r in rows], faults)
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in C.repair(C.damaged(df)).collect()), key=str)


def test_repair_equals_exhaustive_search(spark):
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "ua"], ["Yes.", "No", " ", None, "Why?", "x. \t", "é!"]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, rng.choice(texts) if rng.random() < 0.5 else f"t{turn}."))
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_given_conversations_equal_exhaustive_search(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(df) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_the_automaton_is_exact_on_all_short_sequences(n):
    automaton = C.CostAutomaton()
    names = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
    kinds = [(names[C.INITIALS[s >> 1]] if s != C.GONE else "user", "blank" if s == C.GONE else "truncated" if s & 1 else None) for s in range(C.GONE + 1)]
    for symbols in itertools.product(range(C.GONE + 1), repeat=n):
        cost, audit, _ = best([(kinds[s][0], "x") for s in symbols], [kinds[s][1] for s in symbols])
        assert automaton.solve(bytearray(symbols)) == (cost, audit)
    assert len(automaton.vectors) < 60


def test_empty_table_dropped_conversations_and_clashing_columns(spark):
    assert C.repair(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA).withColumn("times", F.lit(3)).withColumn("symbol", F.lit("x")).withColumn("First", F.lit(1))
    assert found(df) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation_with_repeats_and_a_very_long_text(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(3000)] + [(7, 3000, "user", "w " * 400_000 + ".")] + [(7, 5000, "user", "same.")] * 500
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)
