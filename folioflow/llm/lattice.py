"""Cheapest repairs of a sequence of turns, by the auction algorithm for shortest paths.

Turns come as symbols: `x` for a turn that must go, else the initial of its role (`s`, `u`,
`a`, or `o` for any other), as a capital if its text is truncated. Nodes of the lattice are
(turns done, state), where the state tells what the roles so far look like; an arc is an edit:
Keep, Rerole, Delete or Insert, by its initial. Since the state fixes the role that comes next,
the edits decide the roles.

The auction keeps a price for each node, never above the cost from there to the end, and a
path from the entry. The last node of the path either offers more than its price, then
its price rises and the path is contracted, or has a tight arc, one whose cost is the
difference of two prices, and the path is extended by the tight arc with the least letter. Prices only rise, so an
arc passed over because it was not tight never becomes tight again while its node stays on
the path; so when the path arrives it is the cheapest, and of all cheapest ones the
least in ASCII order. The prices left behind are exact for the nodes it was started from.

Long sequences are cut into short stretches, worked through from the last to the first: the
exact prices of a stretch's entries are the prices at the exits of the one before. So the
effort grows with the length and not with the cost of the whole. Stretches recur, and a
worker keeps those it has solved.
"""

from __future__ import annotations

from functools import lru_cache

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
FAR = 1 << 40  # price of what can't be reached
# Prices behind the last turn: what the missing turns of the last pair cost to insert.
END = (0, 10, 5, 0)
# The costs of the edits.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
STRETCH = 8


def _kept(state: int, initial: str) -> int | None:
    """The state after keeping a turn of this role, if it may stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _arcs(symbols: str, at: int, state: int, exits: tuple, last: bool) -> list[tuple]:
    """(letter, cost, turns done, state) of a node's arcs, in the order of letters; the arc that
    leaves the lattice has no letter."""
    to = _NEXT[state]
    if at == len(symbols):
        out = [("", exits[state], -1, state)] if exits[state] < FAR else []
        return out + [("I", INSERT, at, to)] if last else out
    out = [("D", DELETE, at + 1, state), ("I", INSERT, at, to)]
    symbol = symbols[at]
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        kept = _kept(state, symbol.lower())
        if kept is not None:
            out.append(("K", KEEP + more, at + 1, kept))
        out.append(("R", REROLE + more, at + 1, to))
    return out


def _reaches(symbols: str, entry: int, exits: tuple) -> bool:
    """Whether any exit can be reached: the first two states are only left, never entered again."""
    if exits[USER] < FAR or exits[ASSISTANT] < FAR:
        return True
    if entry == START and (exits[START] < FAR or "s" in symbols.lower()):
        return exits[START] < FAR or exits[SYSTEM] < FAR
    return entry == SYSTEM and exits[SYSTEM] < FAR


@lru_cache(maxsize=200_000)
def _solved(symbols: str, exits: tuple, last: bool) -> tuple:
    """For each entry state: (price, letters, exit state) of a stretch, None where no exit can be
    reached. `last`: turns may be inserted behind the last one."""
    prices: dict = {}
    arcs: dict = {}
    out = []
    for entry in STATES:
        if not _reaches(symbols, entry, exits):
            out.append(None)
            continue
        path, letters = [(0, entry)], []
        while True:
            node = path[-1]
            if node not in arcs:
                arcs[node] = _arcs(symbols, *node, exits, last)
            offer, step = FAR, None
            for letter, cost, at, state in arcs[node]:
                value = cost + (prices.get((at, state), 0) if at >= 0 else 0)
                if value < offer:
                    offer, step = value, (letter, at, state)
            if prices.get(node, 0) < offer:
                prices[node] = offer
                if letters:
                    path.pop()
                    letters.pop()
            elif step[1] < 0:
                out.append((prices.get((0, entry), 0), "".join(letters), step[2]))
                break
            else:
                letters.append(step[0])
                path.append(step[1:])
    return tuple(out)


def _stretch(symbols: str, exits: tuple, last: bool) -> tuple:
    """`_solved` with prices taken from the lowest exit, so that equal stretches meet."""
    base = min(exits)
    if base >= FAR:
        return base, (None,) * len(STATES)
    return base, _solved(symbols, tuple(min(e - base, FAR) if e < FAR else FAR for e in exits), last)


def _backwards(symbols: str, exits: tuple, last: bool) -> tuple[tuple, list]:
    """Prices of the entries, and the solved stretches from the last to the first."""
    stretches = []
    cuts = range(0, max(len(symbols), 1), STRETCH)
    for at in reversed(cuts):
        final = last and at == cuts[-1]
        if final:
            exits = (0, FAR, FAR, 0)
        base, solved = _stretch(symbols[at : at + STRETCH], exits, final)
        exits = tuple(base + s[0] if s else FAR for s in solved)
        stretches.append(solved)
    return exits, stretches


def entry_prices(symbols: str, exits: tuple, last: bool = False) -> tuple:
    """Cost from each entry state to the end, given the prices at the exits."""
    return _backwards(symbols, exits, last)[0]


def repair(symbols: str, entry: int = START, exits: tuple = END, last: bool = True) -> tuple[str, int]:
    """(letters, exit state) of the cheapest edits, the ASCII-least of them."""
    letters = []
    for solved in reversed(_backwards(symbols, exits, last)[1]):
        _, part, entry = solved[entry]
        letters.append(part)
    return "".join(letters), entry


def matrix(symbols: str) -> list[int]:
    """Cost from each entry to each exit, row by row."""
    alone = [tuple(0 if state == to else FAR for state in STATES) for to in STATES]
    columns = [entry_prices(symbols, exits) for exits in alone]
    return [columns[to][entry] for entry in STATES for to in STATES]


def priced(matrix: list[int], exits: tuple) -> tuple:
    """Prices of the entries of a part of which the matrix is known."""
    n = len(STATES)
    return tuple(min(FAR, *(matrix[n * i + j] + exits[j] for j in STATES)) for i in STATES)


def applied(letters: str, symbols: str, turns: list, entry: int = START) -> list[tuple]:
    """(role, text) of the turns after the edits."""
    out, at, state = [], 0, entry
    for letter in letters:
        if letter == "I":
            state = _NEXT[state]
            out.append((ROLES[state], ""))
            continue
        role, text = turns[at]
        if letter == "K":
            state = _kept(state, symbols[at].lower())
            out.append((role, text))
        elif letter == "R":
            state = _NEXT[state]
            out.append((ROLES[state], text))
        at += 1
    return out


def cost(letters: str, symbols: str) -> int:
    """What the edits cost."""
    each = {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}
    rows = iter(symbols)
    total = 0
    for letter in letters:
        total += each[letter]
        if letter != "I":
            symbol = next(rows)
            total += TRUNCATED if letter != "D" and symbol.isupper() else 0
    return total
