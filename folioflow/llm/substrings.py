"""Removal of repeated byte strings with a sparse suffix array, sorted deep-shallow.

A byte goes if a `length`-byte string that covers it also starts anywhere else. Every such
string has an anchor: of its `gram`-byte substrings the one with the smallest hash, the last one
on ties. Equal strings have equal anchors at equal places, so it is enough to compare texts at
anchors, a fiftieth or so of all positions. An anchor's context is the `length - gram` bytes
before and the `length` bytes from it, all that a string with this anchor can cover.

1. Anchors whose gram occurs once, most of them, are dropped by counts per gram hash.
2. Where all contexts of a gram are equal, every string around its anchors repeats.
3. Elsewhere one anchor for each distinct context is kept. These sparse suffixes are sorted by
   what follows, and by what precedes read backwards: a multikey quicksort to a shallow depth,
   then a blind trie for each group with a long common prefix. Common prefixes with the
   neighbours tell for each shift which contexts agree on the whole string.
4. A gram with more than `block` distinct contexts is not sorted in one task: its strings are
   counted by the hashes of gram, shift and string instead, which splits by content.

Only documents with such anchors carry their bytes on; all others are settled when they first
meet their anchors. Texts travel compressed.

Null texts count as empty. Texts shorter than `length` lose nothing. Repeated rows count as
repeats of each other. Long texts are hashed in stretches. Other columns are not used.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.near_dedup import MIX, _mix
from folioflow.llm.suffixes import deep_shallow
from folioflow.llm.tables import release, whole_text, written


@dataclass(frozen=True)
class Settings:
    length: int = 200
    gram: int = 80
    stretch: int = 1 << 20  # string starts hashed at once
    block: int = 4096  # distinct contexts of a gram sorted in one task
    batch: int = 20_000  # contexts sorted at once
    seed: int = 5

    @property
    def shifts(self) -> int:
        """Places at which an anchor can lie in a string."""
        return self.length - self.gram + 1


class Hasher:
    """Hashes of all substrings of given sizes, from sums of powers modulo 2**64."""

    def __init__(self, settings: Settings):
        import numpy as np

        rng = np.random.default_rng(settings.seed)
        self.table = rng.integers(0, 2**63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def sums(self, raw):
        import numpy as np

        n = len(raw)
        if len(self.up) <= n:
            base = np.full(2 * n + 2, MIX[0], dtype=np.uint64)
            inverse = np.full(2 * n + 2, pow(MIX[0], -1, 2**64), dtype=np.uint64)
            base[0] = inverse[0] = 1
            self.up, self.down = np.cumprod(base), np.cumprod(inverse)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.table[raw] * self.up[:n], out=out[1:])
        return out

    def between(self, sums, begin, end):
        """Hashes of raw[begin:end] for arrays of begins and ends."""
        import numpy as np

        size = (end - begin).astype(np.uint64)
        return _mix((sums[end] - sums[begin]) * self.down[begin] + size * np.uint64(MIX[1]))


def anchors(raw: bytes, hasher: Hasher, settings: Settings):
    """Places of the anchors of a text, and hashes of their grams and contexts."""
    import numpy as np

    n, shifts, found = len(raw), settings.shifts, []
    for first in range(0, n - settings.length + 1, settings.stretch):
        base = max(0, first - shifts + 1)
        part = np.frombuffer(raw[base : first + settings.stretch + 2 * settings.length], np.uint8)
        starts = min(settings.stretch, n - settings.length + 1 - first)
        sums = hasher.sums(part)
        place = np.arange(first - base, first - base + starts + shifts - 1)
        grams = hasher.between(sums, place, place + settings.gram)
        high, low = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
        least = (grams & high) | (low - place.astype(np.uint64))
        span = 1
        while 2 * span <= shifts:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < shifts:
            least = np.minimum(least[: span - shifts], least[shifts - span :])
        chosen = (low - (least & low)).astype(np.int64)
        chosen = np.unique(chosen)
        begin = np.maximum(chosen - shifts + 1, 0)
        end = np.minimum(chosen + settings.length, len(part))
        # Contexts cut short at an end of the text must differ from whole ones.
        context = hasher.between(sums, begin, end) + (chosen - begin).astype(np.uint64)
        found.append(
            (base + chosen, grams[chosen - (first - base)].view(np.int64), _mix(context).view(np.int64))
        )
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    place, gram, context = (np.concatenate(x) for x in zip(*found))
    _, once = np.unique(place, return_index=True)
    return place[once], gram[once], context[once]


def _keyed(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", text).alias("row"),
        F.hash(text).alias("tag"),
        text.alias("text"),
    )


def anchor_rows(keyed: DataFrame, settings: Settings, places: bool) -> DataFrame:
    """gram and context hashes of all anchors, with row, tag and place if asked for."""

    def find(batches):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher(settings)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                found = [anchors(t.encode(), hasher, settings) for t in rows.column(2).to_pylist()]
                place, gram, context = (np.concatenate(x) for x in zip(*found))
                columns, names = [pa.array(gram), pa.array(context)], ["gram", "context"]
                if places:
                    source = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
                    columns += [
                        rows.column(0).take(pa.array(source)),
                        rows.column(1).take(pa.array(source)),
                        pa.array(place.astype(np.int32)),
                    ]
                    names += ["row", "tag", "place"]
                yield pa.record_batch(columns, names=names)

    schema = "gram long, context long" + ", row long, tag int, place int" * places
    return keyed.select("row", "tag", "text").mapInArrow(find, schema)


def runs(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the intervals cover."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(intervals):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def covered(place: int, size: int, least: int, most: int, settings: Settings) -> tuple[int, int]:
    """Bytes covered by the strings around an anchor whose shifts lie from least to most."""
    least, most = max(least, place + settings.length - size), min(most, place)
    return place - most, place - least + settings.length


def without(raw: bytes, intervals: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, runs, and what is left."""
    gone, at, kept = runs(intervals), 0, []
    for begin, end in gone:
        kept.append(raw[at:begin])
        at = end
    kept.append(raw[at:])
    return sum(end - begin for begin, end in gone), len(gone), b"".join(kept)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_MET = (
    "done boolean, doc_id long, row long, tag int, n_bytes long, n_removed long, n_spans long,"
    " kept binary, whole array<int>, gram long, times long, place int, around binary"
)


def squeezed(batches):
    """doc_id, row, tag and compressed text, in small parts: a task holds one Arrow batch of
    texts, but not all that becomes of it."""
    import pyarrow as pa
    import zstandard

    compress = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            packed = [compress(t.as_py().encode()) for t in part.column(3)]
            yield pa.record_batch(
                [*part.columns[:3], pa.array(packed, type=pa.binary())],
                names=["doc_id", "row", "tag", "packed"],
            )


def _meet(keyed: DataFrame, lists: DataFrame, settings: Settings, keep) -> DataFrame:
    """Documents meet their anchors: settled ones (done), those that wait for the sorting, with
    their bytes, and the contexts to sort."""

    def meet(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        names = [part.split()[0] for part in _MET.split(", ")]
        kinds = dict(zip(names, [
            pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
            pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int32(), pa.binary(),
        ]))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out: list[dict] = []
                for x in batch.slice(at, 64).to_pylist():
                    raw = unpack(x["packed"])
                    n, whole, open_ = len(raw), x["whole"] or [], x["open"] or []
                    key = {"row": x["row"], "tag": x["tag"]}
                    waits = any(o["times"] == 1 for o in open_)
                    for o in open_:
                        if o["chosen"]:
                            begin, end = o["place"] - settings.shifts + 1, o["place"] + settings.length
                            around = bytes(max(0, -begin)) + raw[max(0, begin) : end]
                            around += bytes(end - begin - len(around))
                            out.append({**key, "gram": o["gram"], "times": o["times"], "n_bytes": n,
                                        "place": o["place"], "around": around})
                    if waits:
                        out.append({**key, "done": False, "doc_id": x["doc_id"], "n_bytes": n,
                                    "kept": x["packed"], "whole": whole})
                        continue
                    spans = [covered(p, n, 0, settings.shifts - 1, settings) for p in whole]
                    removed, count, left = without(raw, spans)
                    out.append({"done": True, "doc_id": x["doc_id"], "n_bytes": n,
                                "n_removed": removed, "n_spans": count, "kept": keep(left)})
                yield pa.record_batch(
                    [pa.array([o.get(name) for o in out], type=kinds[name]) for name in names],
                    names=names,
                )

    packed = keyed.mapInArrow(squeezed, "doc_id long, row long, tag int, packed binary")
    met = packed.join(lists, ["row", "tag"], "left").select(
        "doc_id", "row", "tag", "packed", "whole", "open"
    )
    return written(met.mapInArrow(meet, _MET), "substring-met")


def _agreeing(frame, settings: Settings):
    """Smallest and largest shift (-1: none) at which each context agrees with another one.

    frame: gram, times, place, n_bytes, around; a context met several times agrees with itself.
    """
    import numpy as np

    around = np.frombuffer(b"".join(frame["around"]), np.uint8)
    around = around.reshape(len(frame), settings.shifts - 1 + settings.length)
    _, groups = np.unique(frame["gram"].to_numpy(), return_inverse=True)
    before, after = around[:, : settings.shifts - 1][:, ::-1], around[:, settings.shifts - 1 :]
    after_order, after_common = deep_shallow(np.ascontiguousarray(after), groups)
    before_order, before_common = deep_shallow(np.ascontiguousarray(before), groups)
    n = len(frame)
    place, size = frame["place"].to_numpy("int64"), frame["n_bytes"].to_numpy("int64")
    first, last = np.maximum(0, place + settings.length - size), np.minimum(settings.shifts - 1, place)
    weight = np.minimum(frame["times"].to_numpy("int64"), 2)
    least, most = np.full(n, -1), np.full(n, -1)
    after_set, before_set = np.empty(n, np.int64), np.empty(n, np.int64)
    begins = np.r_[True, np.diff(groups[before_order]) != 0]
    for shift in range(settings.shifts):
        after_set[after_order] = np.cumsum(after_common < settings.length - shift)
        before_set[before_order] = np.cumsum((before_common < shift) | begins)
        fits = np.flatnonzero((first <= shift) & (shift <= last))
        if not len(fits):
            continue
        _, which = np.unique(after_set[fits] * (n + 1) + before_set[fits], return_inverse=True)
        repeated = fits[np.bincount(which, weight[fits])[which] > 1]
        least[repeated] = np.where(least[repeated] < 0, shift, least[repeated])
        most[repeated] = shift
    return least, most


def _sorted(contexts: DataFrame, settings: Settings) -> DataFrame:
    """row, tag, place, least and most for contexts of grams with few contexts."""

    def process(frames):
        import pandas as pd

        waiting = None
        names = ["row", "tag", "place", "least", "most"]

        def done(frame):
            least, most = _agreeing(frame, settings)
            out = frame[["row", "tag", "place"]].assign(least=least, most=most)
            return out[(least >= 0) & (frame["times"] == 1).to_numpy()][names]

        for frame in frames:
            if not len(frame):
                continue
            waiting = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
            if len(waiting) >= settings.batch:
                last = waiting["gram"].iloc[-1]
                whole = (waiting["gram"] != last).to_numpy()
                if whole.any():
                    yield done(waiting[whole].reset_index(drop=True))
                    waiting = waiting[~whole].reset_index(drop=True)
        if waiting is not None:
            yield done(waiting)

    ordered = contexts.repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInPandas(process, "row long, tag int, place int, least int, most int")


def _counted(contexts: DataFrame, settings: Settings) -> DataFrame:
    """The same for grams with very many contexts, by counts of all their strings' hashes.

    A string may lie in the contexts of several anchors, so it is counted by gram and shift.
    """

    def strings(batches):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher(Settings(seed=settings.seed + 1))
        for batch in batches:
            for x in batch.to_pylist():
                shift = np.arange(
                    max(0, x["place"] + settings.length - x["n_bytes"]),
                    min(settings.shifts - 1, x["place"]) + 1,
                )
                raw = np.frombuffer(x["around"], np.uint8)
                begin = settings.shifts - 1 - shift
                hashes = hasher.between(hasher.sums(raw), begin, begin + settings.length)
                same = lambda v, kind: pa.array(np.full(len(shift), v), type=kind)
                yield pa.record_batch(
                    [
                        same(x["gram"], pa.int64()), pa.array(hashes.view(np.int64)),
                        same(x["times"], pa.int64()), same(x["row"], pa.int64()),
                        same(x["tag"], pa.int32()), same(x["place"], pa.int32()),
                        pa.array(shift.astype(np.int32)),
                    ],
                    names=["gram", "hash", "times", "row", "tag", "place", "shift"],
                )

    rows = written(
        contexts.select("row", "tag", "place", "n_bytes", "gram", "times", "around").mapInArrow(
            strings,
            "gram long, hash long, times long, row long, tag int, place int, shift int",
        ),
        "substring-strings",
    )
    key = ["gram", "shift", "hash"]
    repeated = rows.groupBy(*key).agg(F.sum("times").alias("n")).where("n > 1")
    return (
        rows.where("times = 1")
        .join(repeated.select(*key), key)
        .groupBy("row", "tag", "place")
        .agg(F.min("shift").alias("least"), F.max("shift").alias("most"))
    )


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes left) of every row; with `digest`,
    kept is their SHA-256 instead."""
    keep = (lambda raw: hashlib.sha256(raw).digest()) if digest else (lambda raw: raw)
    spark, keyed = docs.sparkSession, _keyed(docs)
    grams = written(
        anchor_rows(keyed, settings, places=False)
        .groupBy("gram")
        .agg(F.count("*").alias("n"), F.min("context").alias("x"), F.max("context").alias("y"))
        .where("n > 1")
        .select("gram", (F.col("x") != F.col("y")).alias("mixed")),
        "substring-grams",
    )
    release(spark)
    found = written(
        anchor_rows(keyed, settings, places=True).join(grams, "gram"), "substring-anchors"
    )
    release(spark)
    contexts = written(
        found.where("mixed")
        .groupBy("gram", "context")
        .agg(F.count("*").alias("times"), F.min(F.struct("row", "tag", "place")).alias("first")),
        "substring-contexts",
    )
    own = F.struct("row", "tag", "place")
    flagged = (
        found.where("mixed")
        .join(contexts, ["gram", "context"])
        .select("row", "tag", "place", "gram", "times", (own == F.col("first")).alias("chosen"))
    )
    every = found.where(~F.col("mixed")).select(
        "row", "tag", "place", F.lit(None).cast("long").alias("gram"),
        F.lit(2).cast("long").alias("times"), F.lit(False).alias("chosen"),
    ).union(flagged)
    lists = every.groupBy("row", "tag").agg(
        F.collect_list(F.when(F.col("times") > 1, F.col("place"))).alias("whole"),
        F.collect_list(
            F.when(
                F.col("chosen") | (F.col("times") == 1), F.struct("gram", "place", "times", "chosen")
            )
        ).alias("open"),
    )
    met = _meet(keyed, lists, settings, keep)
    release(spark)
    around = met.where(F.col("around").isNotNull()).select(
        "row", "tag", "gram", "times", "place", "n_bytes", "around"
    )
    crowded = contexts.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > settings.block)
    crowded = written(crowded.select("gram"), "substring-crowded")
    results = _sorted(around.join(crowded, "gram", "left_anti"), settings).union(
        _counted(around.join(crowded, "gram", "left_semi"), settings)
    )
    spans = results.groupBy("row", "tag").agg(
        F.collect_list(F.struct("place", "least", "most")).alias("spans")
    )
    waiting = met.where(F.col("done") == F.lit(False)).select(
        "doc_id", "row", "tag", "n_bytes", "kept", "whole"
    )
    columns = [part.split()[0] for part in _RESULT.split(", ")]
    settled = met.where(F.col("done")).select(*columns)
    finished = waiting.join(spans, ["row", "tag"], "left").select(
        "doc_id", "n_bytes", "kept", "whole", "spans"
    )

    def finish(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for x in batch.slice(at, 64).to_pylist():
                    raw = unpack(x["kept"])
                    last = settings.shifts - 1
                    spans = [covered(p, len(raw), 0, last, settings) for p in x["whole"] or []]
                    spans += [
                        covered(s["place"], len(raw), s["least"], s["most"], settings)
                        for s in x["spans"] or []
                    ]
                    removed, count, left = without(raw, spans)
                    out.append((x["doc_id"], len(raw), removed, count, keep(left)))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.record_batch(
                    [pa.array(c, type=kind) for c, kind in zip(zip(*out), kinds)], names=columns
                )

    return settled.union(finished.mapInArrow(finish, _RESULT))
