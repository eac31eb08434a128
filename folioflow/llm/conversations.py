"""Repair of the structure of conversations at the least cost, see `lattice`.

A conversation should be an optional system turn and then pairs of a user's and an assistant's
turn. Turns are taken by number, those without one first; turns with one number by role and then
by the beginning of their text. A turn's first fault counts: blank, duplicate (role and text seen
earlier in the conversation) or truncated (does not end like a sentence).

Turns are range-partitioned by conversation and number, so a conversation with a third of all
turns is spread over many tasks, and cut into blocks of a bounded number of turns and
characters. A conversation inside one block is repaired there. Others, and the first and last of
each task, which may go on in the next, are put together from their blocks:
first occurrences of turns by partial sums over hashes of 128 bits; each block's costs from each state
to each state by the auction; prices folded backwards and states forwards, first over the
blocks of each task, then over the tasks of each conversation (a few numbers each); then every block is
repaired from its own state against its exact exit prices. Only the digest of a long
conversation reads its blocks one after another, as a hash of its whole text must; it
streams them.

Null roles and texts count as one blank. A null conv_id is a conversation like others. Repeated rows
are duplicates. A null or empty role fits nowhere and can only be rerolled or deleted. Empty tables
give no rows. Other columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm import lattice
from folioflow.llm.tables import BLANKS, join_on, written

# What may stand beside each other, and how a sentence ends.
LEGAL = ("su", "ua", "au")
STOPS = ".!?"


@dataclass(frozen=True)
class Settings:
    turns: int = 1024  # in a block
    characters: int = 4_000_000  # of a block, beyond which no turn is added


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with faults put in by a hash of the turn's key: one of twenty turns is
    left out, emptied, stripped of its stops, repeated, or made the user's."""
    fault = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = (
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(_text("text"), "[.!?]", ""))
        .otherwise(_text("text"))
    )
    copies = F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    return conversations.where(fault != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(_text("role")).alias("role"), text.alias("text"),
        copies.alias("copy"),
    ).drop("copy")


_BLOCK = (
    "conv_id long, part int, block int, whole boolean, turns array<long>, roles array<string>,"
    " texts array<string>"
)


def blocks(turns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Turns in order, in blocks: part and block tell the order within a conversation; `whole`
    ones hold all of theirs."""
    order = [
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(),
        F.col("role_start"), F.col("text_start"), F.col("text_hash"),
    ]
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _text("role").alias("role"), _text("text").alias("text"),
    ).withColumns(
        {"role_start": F.left("role", F.lit(32)), "text_start": F.left("text", F.lit(64)),
         "text_hash": F.xxhash64("text")}
    )
    # Only equal rows are parted by the last key, so that many of them are not one task's work.
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*order, "salt").sortWithinPartitions(*order)

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["conv_id", "part", "block", "whole", "turns", "roles", "texts"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()),
                 pa.list_(pa.string()), pa.list_(pa.string())]
        now, first, block, held, size, out = None, True, 0, [], 0, []

        def close(complete):
            turns, roles, texts = zip(*held)
            out.append((now, part, block, complete, list(turns), list(roles), list(texts)))

        def frame():
            columns = [pa.array(c, type=kind) for c, kind in zip(zip(*out), kinds)]
            out.clear()
            return pa.record_batch(columns, names=names)

        begun = False
        for batch in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and conv != now:
                    close(block == 0 and not first)
                    first, block, held, size = False, 0, [], 0
                elif len(held) >= settings.turns or size >= settings.characters:
                    close(False)
                    block, held, size = block + 1, [], 0
                    if len(out) > 1:
                        yield frame()
                now, begun = conv, True
                held.append((turn, role, text))
                size += len(text)
            if len(out) >= 512:
                yield frame()
        if held:
            close(False)
        if out:
            yield frame()

    return ranged.select("conv_id", "turn", "role", "text").mapInArrow(cut, _BLOCK)


def faults(roles: list, texts: list, seen_first=None) -> tuple[str, list[int]]:
    """Symbols of the turns, and counts of blank, duplicate and truncated ones. `seen_first`:
    places of the turns that are the first of their kind, where other blocks count too."""
    symbols, counts, seen = [], [0, 0, 0], set()
    for at, (role, text) in enumerate(zip(roles, texts)):
        inside = text.strip(BLANKS)
        if seen_first is not None:
            again = at not in seen_first
        else:
            again = (role, text) in seen
            seen.add((role, text))
        if not inside:
            counts[0] += 1
            symbols.append("x")
        elif again:
            counts[1] += 1
            symbols.append("x")
        else:
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if inside[-1] not in STOPS:
                counts[2] += 1
                initial = initial.upper()
            symbols.append(initial)
    return "".join(symbols), counts


def _illegal(roles: list, before: str | None) -> int:
    initials = ([] if before is None else [before]) + [role[:1] for role in roles]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _distinct(turns: list, before: int | None) -> int:
    """Numbers of sorted turns that don't come before the block already."""
    return len({turn for turn in turns if turn is not None and turn != before})


_REPAIRED = (
    "conv_id long, part int, block int, whole boolean, first_turn long, last_turn long,"
    " numbers long, blank long, duplicate long, truncated long, illegal long, cost long,"
    " audit string, roles array<string>, texts array<string>"
)


def _repaired(row: dict) -> dict:
    symbols, counts = faults(row["roles"], row["texts"], row.get("firsts"))
    exits, last = row.get("exits"), row.get("last", True)
    entry = row.get("entry", lattice.START)
    letters, _ = lattice.repair(symbols, entry, tuple(exits) if exits else lattice.END, last)
    after = lattice.applied(letters, symbols, list(zip(row["roles"], row["texts"])), entry)
    numbers = [turn for turn in row["turns"] if turn is not None]
    return {
        "conv_id": row["conv_id"], "part": row["part"], "block": row["block"], "whole": row["whole"],
        "first_turn": min(numbers, default=None), "last_turn": max(numbers, default=None),
        "numbers": _distinct(row["turns"], row.get("turn_before")),
        "blank": counts[0], "duplicate": counts[1], "truncated": counts[2],
        "illegal": _illegal(row["roles"], row.get("role_before")),
        "cost": lattice.cost(letters, symbols), "audit": letters,
        "roles": [role for role, _ in after], "texts": [text for _, text in after],
    }


def _mapped(rows: DataFrame, function, schema: str) -> DataFrame:
    """A function from row to row, as dictionaries, over slices of Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = [function(row) for row in batch.slice(at, 64).to_pylist()]
                yield from pa.Table.from_pylist(out, schema=kinds).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def _folded(rows: DataFrame, keys: list[str], order: str, function, schema: str) -> DataFrame:
    """`function` of the rows (dictionaries, in order) of each group; groups hold a few numbers for
    each block of a task or each task of a conversation."""

    def run(frame):
        import pandas as pd

        found = function(frame.sort_values(order).to_dict("records"))
        names = [field.split(" ")[0] for field in schema.split(", ")]
        return pd.DataFrame(found, columns=names)

    return rows.groupBy(*keys).applyInPandas(run, schema)


def _product(rows: list) -> list:
    n = len(lattice.STATES)
    total = rows[-1]["matrix"].tolist()
    for row in reversed(rows[:-1]):
        columns = [lattice.priced(row["matrix"].tolist(), total[to::n]) for to in lattice.STATES]
        total = [columns[to][entry] for entry in lattice.STATES for to in lattice.STATES]
    return [{**rows[0], "matrix": total}]


def _exits(rows: list) -> list:
    """Prices behind each row, from the last to the first; the group's own are `exits`, if any."""
    known = rows[0].get("exits")
    prices = lattice.END if known is None else tuple(known.tolist())
    last = rows[0].get("last", True)
    for at in range(len(rows) - 1, -1, -1):
        rows[at].update(exits=list(prices), last=bool(last) and at == len(rows) - 1)
        prices = lattice.priced(rows[at]["matrix"].tolist(), prices)
    return rows


def _composed(rows: list) -> list:
    states = list(lattice.STATES)
    for row in rows:
        states = [int(row["after"][state]) for state in states]
    return [{**rows[0], "after": states}]


def _entries(rows: list) -> list:
    state = int(rows[0].get("entry", lattice.START))
    for row in rows:
        row["entry"] = state
        state = int(row["after"][state])
    return rows


def _after(row: dict) -> dict:
    """The exit state for each entry state, where one can get through."""
    after = []
    for entry in lattice.STATES:
        through = lattice.entry_prices(row["symbols"], tuple(row["exits"]), row["last"])[entry]
        if through >= lattice.FAR:
            after.append(entry)
        else:
            after.append(lattice.repair(row["symbols"], entry, tuple(row["exits"]), row["last"])[1])
    return {**row, "after": after}


def _open(table: DataFrame) -> DataFrame:
    """Repaired blocks of conversations that lie in several blocks."""
    place = ["conv", "part", "block"]
    rows = table.where(~F.col("whole")).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    turn = F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "turn")
    named = F.concat(F.length("turn.roles"), F.lit(":"), "turn.roles", "turn.texts")
    firsts = (
        rows.select(*place, turn).select(*place, "at", F.md5(named.cast("binary")).alias("key"))
        .groupBy("conv", "key").agg(F.min(F.struct("part", "block", "at")).alias("first"))
        .groupBy("conv", "first.part", "first.block").agg(F.collect_list("first.at").alias("firsts"))
    )
    firsts = rows.select(*place).join(firsts, place, "left").withColumn(
        "firsts", F.coalesce("firsts", F.array().cast("array<int>"))
    )
    known = written(rows.join(firsts, place), "conversation-blocks")

    def described(row):
        symbols = faults(row["roles"], row["texts"], set(row["firsts"]))[0]
        return {
            "conv": row["conv"], "part": row["part"], "block": row["block"], "symbols": symbols,
            "matrix": lattice.matrix(symbols), "last_turn": row["turns"][-1], "initial": row["roles"][-1][:1],
        }

    numbers = "conv string, part int, block int, symbols string, matrix array<long>"
    described = _mapped(known, described, f"{numbers}, last_turn long, initial string")
    states = written(described, "conversation-states")
    inside, outside = ["conv", "part"], ["conv"]
    priced = "exits array<long>, last boolean"
    by_part = "conv string, part int"
    matrices = _folded(states.select(*place, "matrix"), inside, "block", _product, f"{by_part}, matrix array<long>")
    part_exits = _folded(matrices, outside, "part", _exits, f"{by_part}, {priced}")
    block_exits = _folded(
        states.select(*place, "symbols", "matrix").join(part_exits, inside),
        inside, "block", _exits, f"{by_part}, block int, symbols string, {priced}",
    )
    moves = written(
        _mapped(block_exits, _after, f"{by_part}, block int, symbols string, {priced}, after array<int>"),
        "conversation-moves",
    ).drop("symbols")
    part_moves = _folded(moves.select(*place, "after"), inside, "block", _composed, f"{by_part}, after array<int>")
    part_entries = _folded(part_moves, outside, "part", _entries, f"{by_part}, entry int")
    entries = _folded(
        moves.join(part_entries, inside), inside, "block", _entries,
        f"{by_part}, block int, {priced}, entry int",
    )
    # What stands before a block: within a task from its own blocks, else from the task before.
    ends = states.select(*place, F.struct("last_turn", "initial").alias("end"))
    part_ends = ends.groupBy(*inside).agg(F.max_by("end", "block").alias("end"))
    before_part = part_ends.select(
        *inside, F.lag("end").over(Window.partitionBy("conv").orderBy("part")).alias("earlier")
    )
    before = ends.select(
        *place, F.lag("end").over(Window.partitionBy(*inside).orderBy("block")).alias("before")
    ).join(before_part, inside)
    before = before.select(*place, F.coalesce("before", "earlier").alias("before"))
    full = known.join(entries, place).join(before, place).withColumns(
        {"turn_before": F.col("before.last_turn"), "role_before": F.col("before.initial")}
    )
    return _mapped(full.drop("conv", "before"), lambda row: _repaired({**row, "firsts": set(row["firsts"])}), _REPAIRED)


def repair(turns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Repaired conversations in blocks: conv_id, part and block (their order), whether the block
    is the whole conversation, its first and last number and how many `numbers` it adds,
    counts of faults, cost, audit (the edits' initials), and roles and texts after the edits."""
    table = written(blocks(turns, settings), "conversations")
    whole = _mapped(table.where("whole"), _repaired, _REPAIRED)
    return whole.unionByName(_open(table))


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def report(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conversation: gaps, counts of faults, cost, audit and repaired_sha256."""
    lines = F.array_join(
        F.zip_with("roles", "texts", lambda role, text: F.concat(role, F.lit(":"), text)), "\n"
    )
    rows = repaired.withColumn("lines", lines).withColumn("any", F.size("roles") > 0)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("numbers"), F.lit(0))
    columns = ["conv_id", gaps.cast("long").alias("gaps"), *_COUNTS, "audit"]
    whole = rows.where("whole").select(*columns, F.sha2(F.col("lines").cast("binary"), 256).alias("repaired_sha256"))

    def put_together(batches):
        import hashlib

        import pyarrow as pa

        def finished(now, least, most, sums, audit, digest):
            gaps = most - least + 1 - sums[0] if most is not None else 0
            return [now, gaps, *sums[1:], "".join(audit), digest.hexdigest()]

        names = ["conv_id", "gaps", *_COUNTS, "audit", "repaired_sha256"]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2

        def frame(out):
            return pa.record_batch(
                [pa.array(c, type=kind) for c, kind in zip(zip(*out), kinds)], names=names
            )

        state, out = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        out.append(finished(*state))
                    state = [row["conv_id"], None, None, [0] * 6, [], hashlib.sha256()]
                    some = False
                if row["first_turn"] is not None:
                    state[1] = row["first_turn"] if state[1] is None else min(state[1], row["first_turn"])
                    state[2] = row["last_turn"] if state[2] is None else max(state[2], row["last_turn"])
                for at, name in enumerate(["numbers", *_COUNTS]):
                    state[3][at] += row[name]
                state[4].append(row["audit"])
                if row["any"]:
                    state[5].update((("\n" if some else "") + row["lines"]).encode())
                    some = True
            if len(out) >= 256:
                yield frame(out)
                out = []
        if state is not None:
            out.append(finished(*state))
        if out:
            yield frame(out)

    parts = rows.where(~F.col("whole")).select(
        "conv_id", "part", "block", "first_turn", "last_turn", "numbers", *_COUNTS, "audit", "lines", "any"
    )
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    others = ordered.mapInArrow(
        put_together,
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
        " audit string, repaired_sha256 string",
    )
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ["gaps", *_COUNTS]]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return join_on(every, whole.union(others), ["conv_id"], "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )
