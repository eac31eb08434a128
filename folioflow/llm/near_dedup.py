"""Near duplicates by b-bit MinHash.

A text's set holds its distinct five-word shingles as 64-bit hashes. Texts with equal sets form
a class, found with partial sums over a hash of the set; only one text of each class, the one
with the smallest id, goes on, so copies are never compared. Of each signature's minima, full
values make the band keys and the low `BITS` bits are packed in planes of 64.

Candidates share a band key. First, each text of a bucket meets the bucket's smallest id; pairs
whose estimated similarity (equal low bits by bit counts, corrected for chance collisions) is
near or above the threshold are confirmed on their full sets, and confirmed links give
components. Then buckets that still hold several components, besides the smallest id, are
compared in blocks of a bounded number of texts. Their texts get a longer signature, whose estimate
is fine enough to tell texts of one template from near duplicates; blocks compare these signatures
and the sizes of the sets first. Only texts that could be linked with one of another component
bring their full sets to the same blocks, where the pairs are confirmed. Texts that links connect
already need no further comparison, so a block returns fewer links than it has texts, and none
between components is lost.

At similarity 0.85, 25 bands of 5 minima miss a pair with probability 7e-7; the margin of both
estimates is five standard errors.

Null and empty texts have no shingles and are linked with nothing. Fewer than five words are
one shingle. Rows with the same doc_id are one document with several texts: what one of
them is linked with, all are. Rows with a null doc_id take no part: their component_id is null
and they are kept. Other columns are not used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.components import components
from folioflow.llm.tables import fresh_name, whole_text, written

BITS = 4  # low bits kept of each minimum
WORDS = 5  # words in a shingle
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # odd multipliers


@dataclass(frozen=True)
class Settings:
    percent: int = 85  # 100 * intersection >= percent * union
    rows: int = 5
    bands: int = 25
    minima: int = 128  # a multiple of 64, at least rows * bands
    fine: int = 1024  # minima of texts in buckets that stay open, a multiple of 64
    block: int = 512  # signatures compared at once
    seed: int = 20

    @property
    def least_estimate(self) -> float:
        j = self.percent / 100
        hit = j + (1 - j) / 2**BITS
        return j - 5 * math.sqrt(hit * (1 - hit) / self.minima) / (1 - 1 / 2**BITS)


def _mix(x):
    """Spread 64-bit values; wraps around."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def shingles(text: str):
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    # Bytes.lower and bytes.split know exactly A-Z and the six ASCII blanks.
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for at in range(width):
        part = hashes[at : len(hashes) - width + 1 + at]
        total = (total + _mix(part + np.uint64(at))) * np.uint64(MIX[0])
    return np.unique(_mix(total))


def minima(sets: list, settings: Settings):
    """Minima (texts x minima) of non-empty sets."""
    import numpy as np

    rng = np.random.default_rng(settings.seed)
    keys = rng.integers(0, 2**63, size=(settings.minima, 2), dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    starts, values = np.cumsum(sizes) - sizes, np.concatenate(sets)
    out = np.empty((len(sets), settings.minima), dtype=np.uint64)
    for k, (mask, factor) in enumerate(keys):
        out[:, k] = np.minimum.reduceat((values ^ mask) * (factor | np.uint64(1)), starts)
    return out


def signature(found, settings: Settings):
    """Band keys (texts x bands) and packed low bits (texts x BITS * minima / 64)."""
    import numpy as np

    bands = np.empty((len(found), settings.bands), dtype=np.uint64)
    for band in range(settings.bands):
        key = np.full(len(found), band + 1, dtype=np.uint64)
        for row in range(settings.rows):
            key = _mix((key + found[:, band * settings.rows + row]) * np.uint64(MIX[0]))
        bands[:, band] = key
    low = _mix(found)
    planes = [
        np.packbits(((low >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=1).view(">u8")
        for bit in range(BITS)
    ]
    return bands.view(np.int64), np.concatenate(planes, axis=1).astype(np.uint64).view(np.int64)


def profiles(docs: DataFrame, settings: Settings, slice_rows: int = 128) -> DataFrame:
    """doc_id, n_shingles, set hashes (s1, s2), bands and planes of every row."""

    def profile(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        def lists(values, width):
            flat = pa.array(np.ascontiguousarray(values).reshape(-1))
            offsets = np.arange(len(values) + 1, dtype=np.int32) * width
            return pa.ListArray.from_arrays(pa.array(offsets), flat)

        n_planes = BITS * settings.minima // 64
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                rows = batch.slice(at, slice_rows)
                sets = [shingles(t) for t in rows.column(1).to_pylist()]
                some = [i for i, s in enumerate(sets) if len(s)]
                bands = np.zeros((len(sets), settings.bands), dtype=np.int64)
                planes = np.zeros((len(sets), n_planes), dtype=np.int64)
                if some:
                    found = minima([sets[i] for i in some], settings)
                    bands[some], planes[some] = signature(found, settings)
                digest = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), "<i8")
                yield pa.record_batch(
                    [
                        rows.column(0),
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        pa.array(digest[0::2].copy()),
                        pa.array(digest[1::2].copy()),
                        lists(bands, settings.bands),
                        lists(planes, n_planes),
                    ],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands", "planes"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(
        profile,
        "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, planes array<long>",
    )


def estimate(a: str, b: str, settings: Settings) -> Column:
    """Similarity from two columns of planes: share of equal low bits, without those that are
    equal by chance."""
    differ = None
    per_plane = settings.minima // 64
    for word in range(per_plane):
        bits = None
        for plane in range(BITS):
            at = plane * per_plane + word
            xor = F.get(a, F.lit(at)).bitwiseXOR(F.get(b, F.lit(at)))
            bits = xor if bits is None else bits.bitwiseOR(xor)
        count = F.bit_count(bits)
        differ = count if differ is None else differ + count
    equal = 1 - differ / settings.minima
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def similar(x, y, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    import numpy as np

    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents with the given ids.

    Always a shuffled join: the number of ids grows with the documents.
    """

    def gather(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                found = [shingles(t).view("<i8") for t in rows.column(1).to_pylist()]
                yield pa.record_batch(
                    [rows.column(0), pa.array(found, type=pa.list_(pa.int64()))],
                    names=["id", "set"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    wanted = ids.select(F.col("id").alias("doc_id")).distinct().hint("merge")
    return texts.join(wanted, "doc_id", "left_semi").mapInArrow(gather, "id long, set array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar enough."""

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            first, second = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                x, y = (c[i].values.to_numpy(zero_copy_only=False) for c in (first, second))
                good.append(similar(x, y, settings.percent))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(
                pa.array(good, type=pa.bool_())
            )

    full = (
        pairs.select("a", "b")
        .join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return full.mapInArrow(compare, "u long, v long")


def _pass(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose signatures are similar enough to confirm."""
    side = lambda id, planes: nodes.select(F.col("id").alias(id), F.col("planes").alias(planes))
    return (
        pairs.join(side("a", "x"), "a")
        .join(side("b", "y"), "b")
        .where(estimate("x", "y", settings) >= settings.least_estimate)
        .select("a", "b")
        .distinct()
    )


def fine_sets(sets: DataFrame, settings: Settings, slice_rows: int = 64) -> DataFrame:
    """(id, size, planes, set): the non-empty sets with packed low bits of `fine` minima."""
    fine = replace(settings, minima=settings.fine, bands=0)

    def profile(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                rows = batch.slice(at, slice_rows)
                found = [row.values.to_numpy(zero_copy_only=False).view("<u8") for row in rows.column(1)]
                planes = signature(minima(found, fine), fine)[1]
                yield pa.record_batch(
                    [
                        rows.column(0),
                        pa.array([len(x) for x in found], type=pa.int64()),
                        pa.array(list(planes), type=pa.list_(pa.int64())),
                        rows.column(1),
                    ],
                    names=["id", "size", "planes", "set"],
                )

    return sets.where(F.size("set") > 0).mapInArrow(profile, "id long, size long, planes array<long>, set array<long>")


def _frame_planes(frame, settings: Settings):
    """Planes of the rows of a block, and the number of the component of each."""
    import numpy as np

    planes = np.stack(frame["planes"].to_numpy()).view(np.uint64)
    _, part = np.unique(frame["root"].to_numpy(), return_inverse=True)
    return planes.reshape(len(frame), BITS, settings.minima // 64), part


def _near(planes, at, other, settings: Settings):
    """Those of other whose estimate with one row is high enough, the nearest first."""
    import numpy as np

    bits = np.bitwise_or.reduce(planes[other] ^ planes[at], axis=1)
    equal = 1 - np.bitwise_count(bits).sum(axis=1) / settings.minima
    near = (equal - 2.0**-BITS) / (1 - 2.0**-BITS) >= settings.least_estimate
    return other[near][np.argsort(-equal[near], kind="stable")]


def _blocks(rows: DataFrame, sizes: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links between different components within buckets, by comparing blocks of texts.

    rows: key, id, root; sizes: key, members; sets: `fine_sets`. A bucket's rows go to blocks by a
    hash of the id, and each pair of blocks is one bounded group. It first meets without sets and
    returns its texts that could be linked; then these meet with them. Pairs are confirmed on the
    spot, unless links found before connect them already; so a group returns fewer links than
    it has rows.
    """
    fine = replace(settings, minima=settings.fine)

    def others(at, right, same_block, part):
        after = right[right > at] if same_block else right
        return after[part[after] != part[at]]

    def flag(frame):
        import numpy as np

        planes, part = _frame_planes(frame, fine)
        size, block = frame["size"].to_numpy(), frame["block"].to_numpy()
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        could = np.zeros(len(frame), dtype=bool)
        for at in left:
            other = others(at, right, i == j, part)
            low, high = np.minimum(size[other], size[at]), np.maximum(size[other], size[at])
            other = other[100 * low >= settings.percent * high]
            near = _near(planes, at, other, fine) if len(other) else other
            could[near] = True
            could[at] |= len(near) > 0
        return frame.loc[could, ["key", "i", "j", "block", "id", "root"]].drop_duplicates()

    def compare(frame):
        import numpy as np
        import pandas as pd

        planes, part = _frame_planes(frame, fine)
        ids, sets, block = (frame[name].to_numpy() for name in ("id", "set", "block"))
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for at in left:
            other = others(at, right, i == j, part)
            for b in _near(planes, at, other, fine) if len(other) else ():
                if part[b] != part[at] and similar(sets[at], sets[b], settings.percent):
                    part[part == part[b]] = part[at]
                    found.append((ids[at], ids[b]))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    count = F.ceil(F.col("members") / settings.block).cast("int")
    placed = rows.join(sets.select("id", "size", "planes"), "id").join(sizes, "key")
    placed = placed.withColumn("blocks", count)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("block", "other")).withColumn(
        "j", F.greatest("block", "other")
    )
    flagged = (
        placed.select("key", "i", "j", "block", "id", "root", "size", "planes")
        .groupBy("key", "i", "j")
        .applyInPandas(flag, "key long, i int, j int, block int, id long, root long")
    )
    return (
        written(flagged, "open-texts").join(sets.select("id", "planes", "set"), "id")
        .groupBy("key", "i", "j")
        .applyInPandas(compare, "u long, v long")
        .distinct()
    )


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = written(profiles(docs, settings), "profiles")
    some = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = written(
        some.groupBy("s1", "s2").agg(F.min("doc_id").alias("id")), "set-classes"
    )
    chosen = some.join(classes, ["s1", "s2"]).where(F.col("doc_id") == F.col("id"))
    nodes = written(
        chosen.select("id", "s1", "s2", "bands", "planes").dropDuplicates(["id", "s1", "s2"]),
        "signatures",
    )
    keys = nodes.select("id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(
        F.min("id").alias("pivot"), F.max("id").alias("last"), F.count("*").alias("members")
    )
    shared = buckets.where(F.col("pivot") < F.col("last")).select("key", "pivot", "members")
    members = written(keys.join(shared, "key"), "buckets")
    first = written(
        _pass(
            members.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
            .distinct(),
            nodes,
            settings,
        ),
        "first-pairs",
    )
    sets = written(full_sets(docs, members), "shingle-sets")
    links = written(confirmed(first, sets, settings), "first-links")
    # Rows with one doc_id and several sets are one document, so their classes are linked too.
    same = some.join(classes, ["s1", "s2"]).where(F.col("doc_id") != F.col("id"))
    twice = (
        some.select("doc_id", "s1", "s2").distinct().groupBy("doc_id")
        .agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    )
    links = links.union(
        same.join(twice, "doc_id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    )
    roots = written(components(links), "first-roots")
    rest = (
        members.where((F.col("members") > 2) & (F.col("id") != F.col("pivot")))
        .join(roots, "id", "left")
        .select("key", "id", "members", F.coalesce("root", "id").alias("root"))
    )
    open_keys = (
        rest.groupBy("key")
        .agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("members").alias("members"))
        .where("least < most")
        .select("key", "members")
    )
    left = written(
        rest.select("key", "id", "root").join(open_keys.select("key"), "key", "left_semi"), "open-rows"
    )
    wanted = left.select("id").distinct()
    fine = written(fine_sets(sets.join(wanted, "id", "left_semi"), settings), "fine-sets")
    found = written(_blocks(left, open_keys, fine, settings), "second-links")
    final = components(links.union(found))
    resolved = (
        classes.join(final, "id", "left")
        .select("s1", "s2", F.coalesce("root", "id").alias("component"))
    )
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(
        F.col("doc_id")
    )
    joined = rows.select("doc_id", "n_shingles", "s1", "s2").join(resolved, ["s1", "s2"], "left")
    return joined.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
