"""Conversation repair against exhaustive search."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import pytest

from tripmill.llm import repair

BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, role, text


def search(rows):
    """Cheapest, then least, audit over (row, state) by a priority queue of whole audits; the repaired rows with it."""
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, said = heapq.heappop(queue)
        if (i, state, audit) in done:
            continue
        done.add((i, state, audit))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, said
        for letter, name in (("u", "user"), ("a", "assistant")):
            if letter in steps[state] and cost < 40:
                heapq.heappush(queue, (cost + 2, audit + "I", i, steps[state][letter], (*said, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, said))
            if fault not in ("blank", "duplicate"):
                cut = int(fault == "truncated")
                if role[:1] in steps[state]:
                    heapq.heappush(queue, (cost + cut, audit + "K", i + 1, steps[state][role[:1]], (*said, f"{role}:{text}")))
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if letter in steps[state]:
                        heapq.heappush(queue, (cost + cut + 2, audit + "R", i + 1, steps[state][letter], (*said, f"{name}:{text}")))


def by_search(rows):
    found, hurt = [], list(damage(rows))
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, judged, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", ""), 0)
        for _, _, role, text in own:
            body = text.strip(BLANKS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            judged.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, said = search(judged)
        found.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0))


def rows():
    dice = random.Random(3)
    made = []
    for conv in range(120):
        for turn in range(dice.randint(1, 9)):
            role = dice.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = dice.choice(["Fine.", "cut off", " ", None, "", f"Own {conv} {turn}!", "é.?", "Same.\n", "x. \t"])
            made.append((conv, dice.choice([turn, turn, turn, None, turn + 3]), role, text))
    made += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None), (-5, None, "user", "A."), (-5, None, "user", "A.")]
    made += [(1000, turn, ["user", "assistant"][turn % 2], f"Turn {turn}.") for turn in range(40)]
    return made + made[:7]


def shown(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_repair_equals_search(spark):
    table = spark.createDataFrame(rows(), "conv_id bigint, turn bigint, role string, text string").repartition(7)
    found = repair.repair_query(table)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert shown(found) == by_search(rows())


def test_dropped_conversation_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    extra = "node string, conv_id bigint, pos string, role string, symbol string, turn bigint, text string, cost string, copy string"
    table = spark.createDataFrame([("n", gone, "p", "user", "s", 0, "Hi.", "c", "d")], extra)
    assert shown(repair.repair_query(table)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_query(table.limit(0)).collect() == []


def test_long_conversation_and_text(spark):
    made = [(1, turn, "user" if turn % 2 == 0 else "assistant", f"Turn {turn}." + "y" * (200_000 if turn == 9 else 0)) for turn in range(1500)]
    table = spark.createDataFrame(made, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    ((conv, gaps, *_, audit, _),) = shown(repair.repair_query(table))
    kept = list(damage(made))
    assert conv == 1 and gaps == 1500 - len({k[1] for k in kept}) - (1500 - 1 - max(k[1] for k in kept)) - min(k[1] for k in kept)
    assert sum(letter != "I" for letter in audit) == len(kept)


@pytest.mark.parametrize("symbols", ["uaua", "sua", "Uxa", "aAou", "xxx", "sssu"])
def test_matrices_agree_with_plans(symbols):
    """The product of the matrices and the plans from the end give one cost."""
    costs = repair.AT_END
    for symbol in reversed(symbols):
        costs = repair.best_edits(symbol, costs)[2]
    ways = [0 if i == 0 else repair.NEVER for i in range(4)]
    for symbol in symbols:
        way = repair.matrix(symbol)
        ways = [min(ways[i] + way[4 * i + j] for i in range(4)) for j in range(4)]
    assert min(w + e for w, e in zip(ways, repair.AT_END)) == costs[0]


def test_suffixes_are_shared(spark):
    made = [(conv, turn, role, f"{conv} {turn}.") for conv in range(50) for turn, role in enumerate(["system", "user", "assistant"][conv % 2 :])]
    told = repair.faulted(spark.createDataFrame([(*m, 0) for m in made], "conv_id bigint, turn bigint, role string, text string, copy int"))
    nodes = told.sortWithinPartitions("conv_id", told["pos"].desc()).mapInArrow(repair.with_nodes, f"{repair.ROW}, node binary, next binary")
    assert nodes.select("node").distinct().count() == 3
