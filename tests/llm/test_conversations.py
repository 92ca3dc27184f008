"""Conversation repair against a search over all edits, and its defined cases."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import types as T

from assayloom.llm.conversations import (
    SuffixAutomaton,
    conversation_reports,
    damaged,
    repair_digests,
    repaired_turns,
)

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SPACES = " \t\n\x0b\x0c\r"


def plain_repair(turns):
    """Cheapest, then ASCII-least edits by a search in order of (cost, audit)."""
    seen, faults = set(), []
    for role, text in turns:
        body = text.strip(SPACES)
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(turns) and state in ("", "a"):
            return faults, cost, audit, "\n".join(lines)
        if (at, state) in done:
            continue
        done.add((at, state))
        moves = [(3, "I", at, r[0], (f"{r}:",)) for r in ("user", "assistant")]
        if at < len(turns):
            role, text = turns[at]
            moves.append((4, "D", at + 1, None, ()))
            if faults[at] not in ("b", "d"):
                p = 3 if faults[at] == "t" else 0
                moves.append((p, "K", at + 1, role[:1], (f"{role}:{text}",)))
                moves += [(3 + p, "R", at + 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
        for more, letter, place, initial, added in moves:
            to = state if initial is None else NEXT.get((state, initial))
            if to is not None:
                heapq.heappush(heap, (cost + more, audit + letter, place, to, lines + added))


def plain_report(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    faults, cost, audit, lines = plain_repair([r[1:] for r in rows])
    numbers = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest(),
    }


@pytest.fixture(scope="module")
def told():
    """Random conversations, one of 300 turns, turns out of order, tied, null and repeated."""
    rng, rows = random.Random(5), []
    for conv in [*range(60), None]:
        for turn in range(300 if conv == 7 else rng.randrange(9)):
            rows.append((
                conv, rng.choice([turn, turn, turn, turn * 2, None]),
                rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                rng.choice(["Yes.", "No!", "cut", " \n", "", "Was ist?\x0b", "é\x00", None, f"{turn}."]),
            ))
    rng.shuffle(rows)
    return rows


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        show = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(show).encode()) % 20
        text = {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def test_reports_equal_a_search_over_all_edits(spark, told):
    frame = spark.createDataFrame(told, SCHEMA).repartition(5)
    got = {r["conv_id"]: r.asDict() for r in repair_digests(damaged(frame), frame).collect()}
    rows = plain_damage(told)
    assert set(got) == {r[0] for r in told}
    for conv, report in got.items():
        report.pop("conv_id")
        assert report == plain_report([r[1:] for r in rows if r[0] == conv]), conv


def test_repaired_turns_follow_the_grammar(spark, told):
    frame = spark.createDataFrame([tuple(" " if x is None and i > 1 else x for i, x in enumerate(r))
                                   for r in told], SCHEMA)
    reports = conversation_reports(frame, frame)
    rows = repaired_turns(frame, reports).collect()
    for conv in {r["conv_id"] for r in rows}:
        own = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        told_roles = "".join(r["role"][:1] for r in own)
        assert told_roles.removeprefix("s") == "ua" * (len(told_roles) // 2)
        assert all(r["text"] == "" for r in own if r["edit"] == "I")


def test_neighbours_share_their_nodes():
    rng = random.Random(2)
    some = sorted({"".join(rng.choices("suaoSUAOx", k=rng.randrange(9))) for _ in range(500)},
                  key=lambda s: s[::-1])
    shared = SuffixAutomaton()
    for signature in some:
        assert shared.solve(signature) == SuffixAutomaton().solve(signature)
    assert shared.solve("") == (0, "")


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_digests(damaged(empty), empty).count() == 0
    schema = T.StructType.fromDDL(SCHEMA + ", letters string, audit string, kind int")
    long_text = "Wort " * 200_000 + "."
    frame = spark.createDataFrame(
        [(1, 0, "user", long_text, "x", "y", 3), (1, 1, "assistant", "Ja.", "x", "y", 3),
         (2, None, "user", "Nein.", "x", "y", 3), (3, 0, "user", "weg", "x", "y", 3)], schema)
    kept = frame.where("conv_id < 3")
    got = {r["conv_id"]: r for r in repair_digests(kept, frame).collect()}
    assert got[1]["audit"] == "KK" and got[1]["cost"] == 0
    want = hashlib.sha256(f"user:{long_text}\nassistant:Ja.".encode()).hexdigest()
    assert got[1]["repaired_sha256"] == want
    assert got[2]["audit"] == "KI" and got[2]["gaps"] == 0
    assert (got[3]["cost"], got[3]["audit"]) == (0, "")
    assert got[3]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
