"""Repair of conversations against brute force: the lattice alone, odd rows, and given tables."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parent))

import folioflow  # noqa: E402
from folioflow.llm import conversations, lattice  # noqa: E402
from folioflow.llm.queries import QUERIES  # noqa: E402

cloudpickle.register_pickle_by_value(folioflow)
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def brute_repair(symbols):
    """(cost, letters) by a table over all turns and states."""
    best = {(len(symbols), state): (10**9, "") for state in range(4)}
    best[len(symbols), 0] = best[len(symbols), 3] = (0, "")
    for at in range(len(symbols), -1, -1):
        for _ in range(4):
            for state in range(4):
                ways = [best.get((at, state), (10**9, ""))]

                def way(cost, letter, to, at):
                    if to in best:
                        ways.append((cost + best[to][0], letter + best[to][1]))

                way(5, "I", (at, NEXT[state]), at)
                if at < len(symbols):
                    way(2, "D", (at + 1, state), at)
                    symbol = symbols[at]
                    more = 5 if symbol.isupper() else 0
                    if symbol != "x":
                        way(1 + more, "R", (at + 1, NEXT[state]), at)
                        if (symbol.lower(), state) in KEPT:
                            way(more, "K", (at + 1, KEPT[symbol.lower(), state]), at)
                best[at, state] = min(ways)
    return best[0, 0]


def brute(rows):
    """Rows of the report for rows (conv_id, turn, role, text)."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        held[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = []
    for conv, turns in held.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        numbers = [turn for turn, _, _ in turns if turn is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, symbols, counts = set(), "", [0, 0, 0]
        for _, role, text in turns:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last[0] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault < 2 else initial.upper() if fault == 2 else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = brute_repair(symbols)
        lines, state, left = [], 0, iter(turns)
        for letter in audit:
            if letter == "I":
                state = NEXT[state]
                lines.append(("user:", "assistant:")[state == 3])
                continue
            _, role, text = next(left)
            if letter != "D":
                state = NEXT[state] if letter == "R" else KEPT[role[:1], state]
                lines.append((role if letter == "K" else ("user", "assistant")[state == 3]) + ":" + text)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=str)


def report(spark, rows, settings=conversations.Settings()):
    table = spark.createDataFrame(
        [(*row, 1, "b", 2) for row in rows],
        "conv_id long, turn long, role string, text string, part int, BLOCK string, audit int",
    )
    fixed = conversations.repair(conversations.damaged(table), settings)
    return sorted((tuple(r) for r in conversations.report(fixed, table).collect()), key=str)


def odd_rows(seed, many, convs, turns):
    rng = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", None, "", "u"]
    texts = ["a.", "b.", "c", "d!", " ", "", None, "e?", "f.\n", "\x0b.\x0c", "ü", "ü.", " ", *[f"t{i}." for i in range(60)]]
    return [
        (rng.choice(convs), rng.choice([None, *range(turns)]), rng.choice(roles), rng.choice(texts))
        for _ in range(many)
    ]


def test_auction_is_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(500):
        symbols = "".join(rng.choices("xsuaoSUAO", weights=[4, 2, 9, 9, 1, 1, 2, 2, 1], k=rng.randint(0, 30)))
        letters, _ = lattice.repair(symbols)
        assert (lattice.cost(letters, symbols), letters) == brute_repair(symbols), symbols


def test_parts_meet_at_exact_prices():
    """A sequence cut anywhere gives the same letters by the matrix of its second part."""
    rng = random.Random(2)
    for _ in range(100):
        symbols = "".join(rng.choices("xsuaoUA", k=rng.randint(2, 30)))
        cut = rng.randint(1, len(symbols) - 1)
        exits = lattice.priced(lattice.matrix(symbols[cut:]), lattice.END)
        first, state = lattice.repair(symbols[:cut], lattice.START, exits, False)
        assert first + lattice.repair(symbols[cut:], state)[0] == lattice.repair(symbols)[0]


def test_long_sequence_takes_linear_effort():
    symbols = "uuuaxUso" * 20_000
    letters, _ = lattice.repair(symbols)
    assert sum(letter != "I" for letter in letters) == len(symbols)


def test_odd_rows(spark):
    rows = odd_rows(3, 500, [1, 1, 2, 3, 4, 5, None], 40)
    assert report(spark, rows) == brute(rows)


def test_conversations_in_many_blocks(spark):
    """One conversation holds most turns; blocks and tasks part it."""
    rows = odd_rows(4, 900, [7] * 12 + [8, 9], 400)
    assert report(spark, rows, conversations.Settings(turns=7)) == brute(rows)


def test_many_equal_rows(spark):
    rows = [(1, 2, "user", "Same.")] * 300 + [(1, 3, "assistant", "Yes.")] * 200 + [(2, 1, "user", "Hi.")]
    assert report(spark, rows, conversations.Settings(turns=16)) == brute(rows)


def test_very_long_texts(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i} " + "word " * 40_000 + ".") for i in range(6)]
    assert report(spark, rows, conversations.Settings(characters=300_000)) == brute(rows)


def test_conversation_that_loses_all_turns(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert report(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert report(spark, []) == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_given_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_conversation_repair"](spark, folder).collect()), key=str)
    assert got == brute(rows)
