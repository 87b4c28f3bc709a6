"""Conversation repair against a plain dynamic program that carries whole audits."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from ionloom.llm import conversations
from ionloom.llm.conversations import crossings, forward, table_of

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def repaired_by_hand(rows):
    """``(cost, audit, lines)`` for rows ``(initial, must go, truncated, role, text)``; lines are the repaired turns."""
    best = {0: (0, "", ())}

    def inserts(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                role = "assistant" if state == 2 else "user"
                to = NEXT[state, role[0]]
                way = (cost + 3, audit + "I", (*lines, f"{role}:"))
                ways[to] = min(ways.get(to, way), way)
        return ways

    for initial, gone, cut, role, text in rows:
        # an insert may precede the row's edit from every state, so ways with and without inserts are kept apart
        starts = [(s, w) for s, w in best.items()] + [(s, w) for start in best for s, w in inserts({start: best[start]}).items()]
        after = {}
        for state, (cost, audit, lines) in starts:
            ways = [(state, (cost + 4, audit + "D", lines))]
            if not gone:
                wanted = "assistant" if state == 2 else "user"
                ways.append((NEXT[state, wanted[0]], (cost + 3 + 3 * cut, audit + "R", (*lines, f"{wanted}:{text}"))))
                if (state, initial) in NEXT:
                    ways.append((NEXT[state, initial], (cost + 3 * cut, audit + "K", (*lines, f"{role}:{text}"))))
            for to, way in ways:
                after[to] = min(after.get(to, way), way)
        best = after
    return min(w for start in best for s, w in inserts({start: best[start]}).items() if s in (0, 3))


def digests_by_hand(rows):
    """The contract's columns for rows ``(conv_id, turn, role, text)`` after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1]), str(r[2])))
        seen, judged, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            role, text = " " if role is None else role, " " if text is None else text
            bare = text.rstrip("\x20\t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", role, text))
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, lines = repaired_by_hand(judged)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if f == 1 else "".join(c for c in text if c not in ".!?") if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


@pytest.mark.parametrize("size", range(1, 5))
def test_crossings_of_all_short_conversations(size):
    rows = [("", True, False)] + [(i, False, bool(c)) for i in ("s", "u", "a", "") for c in range(2)]
    draw = random.Random(size)
    every = list(product(range(9), repeat=size)) if size < 4 else [tuple(draw.randrange(9) for _ in range(draw.randrange(4, 14))) for _ in range(800)]
    for kinds in every:
        elements = [conversations.KINDS[k] for k in kinds]
        states = crossings(elements, 0, conversations.CLOSING)
        before = [0, *states[:-1]]
        cost, audit = 0, ""
        for k, s, t in zip(kinds, before, states, strict=True):
            part, letters = conversations.ROWS[k][s, t]
            cost, audit = cost + part, audit + letters
        audit += "I" * conversations.ENDINGS[states[-1]]
        cost += conversations.CLOSING[states[-1]]
        assert (cost, audit) == repaired_by_hand([(*rows[k], "x", "y") for k in kinds])[:2]


def test_a_table_stands_for_its_rows():
    draw = random.Random(1)
    for _ in range(200):
        rows = [conversations.KINDS[draw.randrange(9)] for _ in range(draw.randrange(2, 12))]
        cut = draw.randrange(1, len(rows))
        joined = [table_of(rows[:cut]), table_of(rows[cut:])]
        for start in range(4):
            whole, parts = forward(rows, start), forward(joined, start)
            reached = [q for q in range(4) if whole[q][0] < conversations.NEVER]
            assert [whole[q][0] for q in range(4)] == [parts[q][0] for q in range(4)]
            assert sorted(reached, key=lambda q: whole[q][1]) == sorted(reached, key=lambda q: parts[q][1])
        assert crossings(rows, 0, conversations.CLOSING)[cut - 1] == crossings(joined, 0, conversations.CLOSING)[0]


def made_conversations():
    draw = random.Random(5)
    texts = ["Yes.", "No!", "what is it?", "cut off here", "", " \n", "ends so. \t", None, "ü."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "superuser"]
    rows = []
    for conv in range(60):
        size = draw.choice([1, 2, 5, 9])
        rows += [(conv, t, draw.choice(roles), draw.choice(texts) or "") for t in range(size)]
    rows += [(77, t, draw.choice(["user", "assistant"]), f"turn {t}{draw.choice(['.', ''])}") for t in range(300)]
    rows += [(None, 1, "user", "a row without an id."), (None, None, None, None), (78, None, "user", "no turn."), (78, 4, "assistant", "late")]
    rows += [(79, 1, "user", "the same row.")] * 3
    return rows


def spread(spark, rows, parts):
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, `row` string, kind string")
    return frame.repartition(parts)


def found(spark, turns):
    return {r[0]: tuple(r[1:]) for r in conversations.digests(turns, turns).collect()}


@pytest.mark.parametrize("levels", [(13, 33, 43, 63), (3, 6, 33, 63)])
def test_digests_equal_brute_force_at_every_level(spark, monkeypatch, levels):
    monkeypatch.setattr(conversations, "LEVELS", levels)
    saved = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(levels[0] > 3).lower())
    rows = made_conversations()
    try:
        assert found(spark, spread(spark, rows, 3)) == digests_by_hand(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", saved)


def test_damage_and_edits(spark):
    rows = [(c, t, r, "Said so. Twice!") for c in range(40) for t, r in enumerate(("system", "user", "assistant", "user", "assistant"))]
    turns = spread(spark, [*rows, (None, None, None, None)], 2)
    damaged = conversations.damaged(turns)
    names = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(names, damaged.collect())) == sorted(map(names, damaged_by_hand([*rows, (None, None, None, None)])))
    repaired = conversations.edits(damaged).where("edit <> 'D'").orderBy("conv_id", "row", "part").collect()
    for conv in range(40):
        initials = "".join(r["role"][0] for r in repaired if r["conv_id"] == conv)
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2)


def test_conversation_all_dropped_and_no_rows(spark):
    turns = spread(spark, [(1, 0, "user", "Yes.")], 1)
    gone = conversations.digests(turns.limit(0), turns).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.digests(turns.limit(0), turns.limit(0)).count() == 0


def test_long_text(spark):
    long = "word " * 1_000_000
    rows = [(1, 0, "user", long + "."), (1, 1, "assistant", long), (1, 2, "user", "x" * 3_000_000 + ". \n")]
    assert found(spark, spread(spark, rows, 1)) == digests_by_hand(rows)
