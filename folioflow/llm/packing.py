"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Documents are encoded, and those longer than the capacity cut into full pieces and a rest.
Full pieces fill a sequence of their own. All others are placed in rounds. A round sorts
documents and open gaps by size into ranges, largest first, a gap before a document of its
size. Each range is swept once: gaps go on a stack, and a document takes the top one, which is
its successor, the smallest gap that still holds it; what is left of the gap comes up again
when the documents have become small enough. Documents that find the stack of their range
empty, and gaps that are left at its end, are ranked by size. How many there are of each size
in each range, a few numbers for each size up to the capacity, tells which ranks meet
across ranges: from the largest size down, documents take the smallest gaps that hold them, and what
that leaves of a gap meets later documents in the same round. Runs of ranks that meet are held by
two offsets, so the plan grows with the number of sizes and not with that of documents. One join on
range and rank then brings documents and sequences together. Gaps too small for any open document close,
and the next round begins with what fitted nowhere.

Each round opens as many empty sequences as its tokens need at least. Documents below `bundle` tokens are put together in bundles
of less than twice that size beforehand, so that the number of rounds depends on the capacity
and not on the number of tiny documents. Each round is a written table.

Null texts count as empty and give the end id alone. Rows with the same doc_id, and null ids,
are packed like any others. Empty tables give no rows. Other columns are not used.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.encoding import Encoder
from folioflow.llm.tables import whole_text, written


@dataclass(frozen=True)
class Settings:
    tokenizer: str
    end_id: int
    word_level: bool
    capacity: int = 4096
    bundle: int = 64


def pieces(docs: DataFrame, settings: Settings, slice_rows: int = 256) -> DataFrame:
    """Pieces of every document: item (unique), doc_id, piece, start, length, ids_crc32 and the
    unit they are packed in (the item, or a bundle, whose number is negative) with the place
    there."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = Encoder(settings.tokenizer, settings.word_level)
        end = np.array([settings.end_id], dtype="<u4").tobytes()
        width = 4 * settings.capacity
        item = TaskContext.get().partitionId() << 33
        bundle, filled = -1 - item, 0
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                rows = batch.slice(at, slice_rows)
                out = []
                ids = rows.column(0).to_pylist()
                for doc_id, raw in zip(ids, encoder.encode(rows.column(1).to_pylist())):
                    raw += end
                    for piece, begin in enumerate(range(0, len(raw), width)):
                        part = raw[begin : begin + width]
                        size, unit, place = len(part) // 4, item, 0
                        if size < settings.bundle:
                            unit, place = bundle, filled
                            filled += size
                            if filled >= settings.bundle:
                                bundle, filled = bundle - 1, 0
                        out.append(
                            (item, doc_id, piece, begin // 4, size, zlib.crc32(part), unit, place)
                        )
                        item += 1
                names = ["item", "doc_id", "piece", "start", "length", "ids_crc32", "unit", "place"]
                kinds = [pa.int64(), pa.int64(), pa.int32()] + [pa.int64()] * 5
                columns = [pa.array(x, type=kind) for x, kind in zip(zip(*out), kinds)]
                yield pa.record_batch(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(
        cut,
        "item long, doc_id long, piece int, start long, length long, ids_crc32 long,"
        " unit long, place long",
    )


# What a row of a sweep is: a gap left at the end of its range, a document without a gap, or a
# document with its gap.
GAP, OPEN, PLACED = 0, 1, 2
_SWEPT = "part int, role int, rank long, unit long, size long, seq long, gap long"


def _sweep(state: DataFrame) -> DataFrame:
    """Sweeps the ranges of (unit, size, seq, gap), where a row is a document or a gap."""
    size = F.coalesce("size", "gap").desc()
    order = [size, F.col("unit").isNotNull(), F.coalesce("unit", "seq")]
    ranged = state.repartitionByRange(*order).sortWithinPartitions(*order)

    def sweep(frames):
        import pandas as pd
        from pyspark import TaskContext

        # Both hold gaps as (-size, sequence): the stack from the largest to the smallest, the
        # heap what is left of used ones, which no document so far would fit.
        part, stack, left, waiting = TaskContext.get().partitionId(), [], [], 0
        columns = ["part", "role", "rank", "unit", "size", "seq", "gap"]

        def frame(rows):
            return pd.DataFrame(rows, columns=columns).astype("Int64")

        for rows in frames:
            out = []
            documents = rows["unit"].notna().to_numpy()
            unit, size, seq, gap = (
                rows[name].fillna(0).to_numpy("int64").tolist() for name in columns[3:]
            )
            for i, document in enumerate(documents.tolist()):
                now = size[i] if document else gap[i]
                while left and -left[0][0] >= now:
                    stack.append(heappop(left))
                if not document:
                    stack.append((-now, seq[i]))
                elif stack:
                    room, number = stack.pop()
                    out.append((part, PLACED, None, unit[i], now, number, -room))
                    if -room > now:
                        heappush(left, (room + now, number))
                else:
                    out.append((part, OPEN, waiting, unit[i], now, None, None))
                    waiting += 1
            yield frame(out)
        rest = sorted(stack + left)
        yield frame([(part, GAP, k, None, None, n, -room) for k, (room, n) in enumerate(rest)])

    return ranged.mapInPandas(sweep, _SWEPT)


def _plan(documents: list, gaps: list) -> tuple[list, list]:
    """Which ranks of waiting documents meet which ranks of gaps.

    documents, gaps: (part, size, first rank, how many), each of one size. Returns meetings
    (part, first rank, last rank, part of the gaps, first of their ranks, gap before) and what is left
    (part of the gaps, first rank, last rank, gap). A run of gaps is met as a whole or cut in two.
    """
    runs: dict[int, list] = {}
    for part, size, first, many in sorted(gaps, reverse=True):
        runs.setdefault(size, []).append((part, first, many))
    sizes = sorted(runs)
    meetings = []

    def add(size, run):
        if size not in runs:
            insort(sizes, size)
            runs[size] = []
        runs[size].append(run)

    for part, size, first, many in sorted(documents, key=lambda d: (-d[1], d[0], d[2])):
        while many:
            at = bisect_left(sizes, size)
            if at == len(sizes):
                break
            room = sizes[at]
            gap_part, gap_first, free = runs[room].pop()
            taken = min(many, free)
            meetings.append((part, first, first + taken - 1, gap_part, gap_first, room))
            if free > taken:
                runs[room].append((gap_part, gap_first + taken, free - taken))
            if not runs[room]:
                del runs[room], sizes[at]
            if room > size:
                add(room - size, (gap_part, gap_first, taken))
            first, many = first + taken, many - taken
    left = [(part, first, first + many - 1, size) for size in sizes for part, first, many in runs[size]]
    return meetings, left


def _looked_up(rows: DataFrame, plan: list, columns: list[str], schema: str) -> DataFrame:
    """Rows of (part, rank) with the columns of the plan's entry (part, first, last, ...) that
    holds the rank, where there is one, and how far the rank lies behind the first."""
    entries: dict = {}
    for part, *entry in plan:
        entries.setdefault(part, []).append(entry)
    entries = {part: sorted(own) for part, own in entries.items()}
    # Bounded by the number of sizes below the capacity and of partitions, see `_plan`.
    held = rows.sparkSession.sparkContext.broadcast(entries)

    def look(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            found = []
            for part, group in frame.groupby("part"):
                own = held.value.get(part)
                group = group.copy()
                for name in ["behind", *columns]:
                    group[name] = pd.array([None] * len(group), dtype="Int64")
                if own:
                    table = np.array(own, dtype=np.int64)
                    rank = group["rank"].to_numpy("int64")
                    at = np.maximum(np.searchsorted(table[:, 0], rank, side="right") - 1, 0)
                    inside = (rank >= table[at, 0]) & (rank <= table[at, 1])
                    values = {"behind": rank - table[at, 0]}
                    values |= {name: table[at, 2 + k] for k, name in enumerate(columns)}
                    for name, value in values.items():
                        group[name] = pd.array(np.where(inside, value, 0), dtype="Int64")
                        group.loc[~inside, name] = pd.NA
                found.append(group)
            if found:
                yield pd.concat(found)

    return rows.mapInPandas(look, schema)


def _round(state: DataFrame) -> tuple[DataFrame, int]:
    """One round: its table (unit, size, seq, gap, left), and how many documents are still open.

    `left` is the gap that goes into the next round, on one row of each sequence that has any.
    """
    swept = written(_sweep(state), "packing-sweep")
    counts = (
        swept.groupBy("part", "role", F.coalesce("size", "gap").alias("size"))
        .agg(F.min("rank").alias("first"), F.count("*").alias("many")).collect()
    )  # a row for each size below the capacity, and one more for each partition, at most
    of = lambda role: [(c.part, c.size, c.first, c.many) for c in counts if c.role == role]
    meetings, left = _plan(of(OPEN), of(GAP))
    met = sum(last - first + 1 for _, first, last, *_ in meetings)
    waiting = sum(c.many for c in counts if c.role == OPEN) - met
    columns = ["unit", "size", "seq", "gap"]
    documents = _looked_up(
        swept.where(F.col("role") == OPEN).select("part", "rank", "unit", "size"),
        meetings, ["gap_part", "gap_first", "room"],
        "part int, rank long, unit long, size long, behind long, gap_part long, gap_first long, room long",
    )
    gaps = swept.where(F.col("role") == GAP)
    # Only documents that meet a gap go through the join.
    joined = (
        documents.where(F.col("gap_part").isNotNull()).select(
            "unit", "size", F.col("gap_part").cast("int").alias("part"),
            (F.col("gap_first") + F.col("behind")).alias("rank"), F.col("room").alias("gap"),
        )
        .join(gaps.select("part", "rank", "seq"), ["part", "rank"])
    )
    none = F.lit(None).cast("long")
    local = swept.where(F.col("role") == PLACED).select(*columns, none.alias("left"))
    waits = documents.where(F.col("gap_part").isNull()).select(
        "unit", "size", none.alias("seq"), none.alias("gap"), none.alias("left")
    )
    free = _looked_up(
        gaps.select("part", "rank", "seq"), left, ["room"],
        "part int, rank long, seq long, behind long, room long",
    )
    free = free.where(F.col("room").isNotNull()).select(
        none.alias("unit"), none.alias("size"), "seq", F.col("room").alias("gap"), F.col("room").alias("left")
    )
    rows = local.union(joined.select(*columns, none.alias("left"))).union(waits).union(free)
    return written(rows, "packing-round"), waiting


def _empty(spark, first: int, number: int, capacity: int) -> DataFrame:
    none = F.lit(None).cast("long")
    return spark.range(first, first + number).select(
        none.alias("unit"), none.alias("size"), F.col("id").alias("seq"),
        F.lit(capacity).cast("long").alias("gap"),
    )


def place(units: DataFrame, capacity: int) -> DataFrame:
    """(unit, seq, offset) for every (unit, size), sizes below the capacity."""
    spark = units.sparkSession
    none = F.lit(None).cast("long")
    waiting = written(
        units.select("unit", "size", none.alias("seq"), none.alias("gap")), "packing-units"
    )
    gaps, rounds, sequences = None, [], 0
    count = 1
    while count:
        open_now = waiting.agg(F.sum("size").alias("tokens"), F.count("*").alias("n"), F.min("size").alias("least")).first()
        if not open_now.n:
            break
        state = waiting
        if gaps is not None:
            state = state.union(gaps.where(F.col("gap") >= open_now.least))
        more = -(-open_now.tokens // capacity)
        state = state.union(_empty(spark, sequences, more, capacity))
        sequences += more
        table, count = _round(state)
        rounds.append(
            table.where(F.col("unit").isNotNull() & F.col("seq").isNotNull())
            .select("unit", "size", "seq", "gap")
        )
        waiting = table.where(F.col("seq").isNull()).select("unit", "size", "seq", "gap")
        gaps = table.where(F.col("left") > 0).select(
            none.alias("unit"), none.alias("size"), "seq", F.col("left").alias("gap")
        )
    every = waiting.limit(0)
    for table in rounds:
        every = every.union(table)
    return every.select("unit", "seq", (capacity - F.col("gap")).alias("offset"))


def pack(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    items = written(pieces(docs, settings), "packing-pieces")
    whole = F.col("length") == settings.capacity
    units = items.where(~whole).groupBy("unit").agg(F.sum("length").alias("size"))
    places = place(units, settings.capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = items.where(whole).select(
        *columns, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    shared = items.where(~whole).join(places, "unit")
    return alone.union(
        shared.select(*columns, F.col("seq").alias("sequence_id"), F.col("offset") + F.col("place"))
    )
