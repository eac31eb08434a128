"""Approximate nearest neighbours by cosine, with an adaptive dimension scan.

Equal vectors form a class with the smallest of its ids, as many as a result can hold; so
copies, however many, are compared once. Classes are put into `lists` lists by the nearest centroid of a
bounded sample, and the number of lists that a query probes is calibrated on that sample, so
that `target` of the sample's own neighbours lie in the probed lists.

Vectors are scaled to length one and rotated at random, so that the first columns already estimate a
distance. A task takes a part of a list as column blocks and streams the queries that probe it. From
the first block of columns it takes the most promising candidates and their full distances,
which bound what a neighbour may be away. Then, block by block, a candidate is abandoned when
its partial distance, carried on to all columns, exceeds that bound by more than chance allows
(`doubt` standard deviations of the estimate). The best that are left are scored on the original vectors
in double precision.

Lists are split into parts of about `part` classes, so a list with most of the vectors is many tasks' work.
The sample (at most `sample` vectors and 64 MB), its centroids and the rotation are the only data at the driver and
broadcast.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id and
vectors of another length than most. Equal rows count once. An id with several vectors is a candidate with each, and a
query with each; its own id is never among its neighbours. Empty tables give no rows. Other
columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from folioflow.llm.tables import written


@dataclass(frozen=True)
class Settings:
    best: int = 5
    lists: int = 32
    sample: int = 16_384
    target: float = 0.97
    columns: int = 16  # of a block of columns
    doubt: float = 2.1
    promising: int = 24  # candidates in full before any is abandoned
    part: int = 131_072  # classes scanned by one task at once
    queries: int = 128  # queries scanned together
    seed: int = 11


@dataclass
class Index:
    """Centroids (lists x dimensions), the rotation, and how many lists to probe."""

    centroids: object
    rotation: object
    probes: int

    def order(self, vectors):
        """Lists by descending nearness for each vector."""
        import numpy as np

        return np.argsort(-(vectors @ self.centroids.T), axis=1, kind="stable")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    kind = vectors.schema["embedding"].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<float>" if plain else "array<double>").alias("embedding"),
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("embedding") == (most.size if most else 0))


def _kind(rows: DataFrame) -> str:
    return "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "<f8"


def packed(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id, value (the vector's bytes) and key (a hash of 128 bits)."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            raw = (flat + 0.0).tobytes()  # one zero for both signs
            size = len(raw) // max(batch.num_rows, 1)
            values = [raw[at : at + size] for at in range(0, len(raw), size)] if size else []
            yield pa.record_batch(
                [batch.column(0), pa.array(values, pa.binary()),
                 pa.array([xxh3_128_digest(v) for v in values], pa.binary())],
                names=["vec_id", "value", "key"],
            )

    return rows.mapInArrow(pack, "vec_id long, value binary, key binary")


def classes(rows: DataFrame, queries: Column, best: int) -> DataFrame:
    """key, value, the best + 1 smallest ids, and whether a query is among all ids.

    Batches are aggregated before the shuffle, so even a class with most rows brings few.
    """

    def merge(batches):
        import pyarrow as pa

        for batch in batches:
            ids, values, asked = {}, {}, {}
            for vec_id, value, key, query in zip(*(c.to_pylist() for c in batch.columns)):
                ids.setdefault(key, set()).add(vec_id)
                values[key] = value
                asked[key] = asked.get(key, False) or query
            yield pa.record_batch(
                [pa.array(list(values), pa.binary()), pa.array(list(values.values()), pa.binary()),
                 pa.array([sorted(ids[key])[: best + 1] for key in values], pa.list_(pa.int64())),
                 pa.array(list(asked.values()), pa.bool_())],
                names=["key", "value", "ids", "query"],
            )

    asked = F.coalesce(queries, F.lit(False)).alias("query")
    merged = rows.select("vec_id", "value", "key", asked).mapInArrow(
        merge, "key binary, value binary, ids array<long>, query boolean"
    )
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, best + 1)
    return merged.groupBy("key").agg(
        F.first("value").alias("value"), least.alias("ids"), F.max("query").alias("query")
    )


def matrix(values: list, kind: str):
    """Vectors as rows in double precision. Scaled by powers of two, so that no sum overflows;
    that changes no cosine."""
    import numpy as np

    rows = np.frombuffer(b"".join(values), dtype=kind).astype(float).reshape(len(values), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def unit(rows):
    import numpy as np

    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def cosine(a, b):
    """Of each row of both; the same for the same two vectors wherever they stand."""
    import numpy as np

    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def fit(values: list, kind: str, settings: Settings) -> Index:
    """Spherical k-means on the sample's distinct vectors, and the lists to probe."""
    import numpy as np

    rng = np.random.default_rng(settings.seed)
    vectors = unit(matrix(sorted(set(values)), kind))
    many = max(1, min(settings.lists, len(vectors) // 32))
    centroids = vectors[rng.choice(len(vectors), many, replace=False)]
    for _ in range(10):
        nearest = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        held = np.linalg.norm(sums, axis=1) > 1e-9
        centroids[held] = unit(sums[held])
    rotation = np.linalg.qr(rng.normal(size=(vectors.shape[1], vectors.shape[1])))[0]
    index = Index(centroids, rotation, many)
    asked = rng.choice(len(vectors), min(512, len(vectors)), replace=False)
    if many > 1 and len(vectors) > settings.best + 1:
        near = vectors[asked] @ vectors.T
        near[np.arange(len(asked)), asked] = -2
        best = np.argpartition(-near, settings.best, axis=1)[:, : settings.best]
        place = np.argsort(index.order(vectors[asked]), axis=1)
        homes = np.argmax(vectors @ centroids.T, axis=1)[best]
        ranks = np.sort(np.take_along_axis(place, homes, axis=1).ravel())
        index.probes = int(ranks[min(len(ranks) - 1, int(settings.target * len(ranks)))]) + 1
    return index


class Part:
    """A part of a list: ids, original vectors, and their rotated form in columns."""

    def __init__(self, ids: list, values: list, kind: str, rotation):
        import numpy as np

        self.ids, self.kind = ids, kind
        self.least = np.array([own[0] for own in ids])
        self.originals = np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1)
        rows = unit(matrix(values, kind)) @ rotation
        self.columns = np.ascontiguousarray(rows.T, dtype=np.float32)

    def scan(self, queries: list, rotation, settings: Settings):
        """For each query: (places, scores) of the best classes of the part."""
        import numpy as np

        originals = matrix(queries, self.kind)
        asked = (unit(originals) @ rotation).astype(np.float32)
        size, many = self.columns.shape
        best = min(settings.best + 1, many)
        width = settings.columns

        def partial(at):
            """Squared distances in a block of columns, of all queries and candidates."""
            a, b = asked[:, at : at + width], self.columns[at : at + width]
            return (a * a).sum(1)[:, None] + (b * b).sum(0)[None, :] - 2 * (a @ b)

        total = partial(0)
        # Full distances of the most promising bound the distance of the best.
        first = min(settings.promising, many)
        near = np.argpartition(total, first - 1, axis=1)[:, :first] if first < many else (
            np.broadcast_to(np.arange(many), (len(asked), many))
        )
        apart = self.columns[:, near].transpose(1, 2, 0) - asked[:, None, :]
        bound = np.sort((apart * apart).sum(axis=2), axis=1)[:, best - 1]
        alive, dense = np.ones(total.shape, dtype=bool), True
        for at in range(width, size, width):
            seen = at / size
            chance = (1 + settings.doubt / np.sqrt(at)) ** 2
            if dense:
                alive &= total <= (bound * seen * chance)[:, None] + 1e-6
                dense = alive.mean() > 0.2
                if dense:
                    total += partial(at)
                    continue
                of, place = np.nonzero(alive)
                far = total[of, place]
            else:
                keep = far <= (bound * seen * chance)[of] + 1e-6
                of, place, far = of[keep], place[keep], far[keep]
            apart = self.columns[at : at + width, place].T - asked[of, at : at + width]
            far = far + (apart * apart).sum(axis=1)
        if dense:
            of, place = np.nonzero(alive)
            far = total[of, place]
        # The bound holds for the promising ones too, up to rounding in single precision.
        keep = far <= bound[of] + 1e-4
        of, place, far = of[keep], place[keep], far[keep]
        out, begins = [], np.searchsorted(of, np.arange(len(asked) + 1))
        for q in range(len(asked)):
            own = slice(begins[q], begins[q + 1])
            places, away = place[own], far[own]
            if len(places) > best:
                places = places[away <= np.partition(away, best - 1)[best - 1] + 1e-4]
            rows = matrix([self.originals[p].tobytes() for p in places], self.kind)
            scores = cosine(np.broadcast_to(originals[q], rows.shape), rows) if len(places) else np.zeros(0)
            order = np.lexsort((self.least[places], -scores))[:best]
            out.append((places[order], scores[order]))
        return out


def _scanned(table: DataFrame, kind: str, held, settings: Settings) -> DataFrame:
    """key, vec_id, score: the best of each part for each query that probes it.

    Rows come sorted by list and part, a part's vectors before its queries.
    """

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        index = held.value
        now, part, ids, values, asked = None, None, [], [], []

        def answer():
            nonlocal part
            if not ids or not asked:
                return
            if part is None:
                part = Part(ids, values, kind, index.rotation)
            for at in range(0, len(asked), settings.queries):
                chosen = asked[at : at + settings.queries]
                keys, found, scores = [], [], []
                best = part.scan([value for _, value in chosen], index.rotation, settings)
                for (key, _), (places, own) in zip(chosen, best):
                    for place, score in zip(places, own):
                        keys += [key] * len(ids[place])
                        found += ids[place]
                        scores += [score] * len(ids[place])
                yield pa.record_batch(
                    [pa.array(keys, pa.binary()), pa.array(found, pa.int64()),
                     pa.array(np.array(scores, dtype=float))],
                    names=["key", "vec_id", "score"],
                )
            asked.clear()

        for batch in batches:
            lists, parts, query, keys, own, vectors = (c.to_pylist() for c in batch.columns)
            for at in range(batch.num_rows):
                if (lists[at], parts[at]) != now:
                    yield from answer()
                    now, part, ids, values, asked = (lists[at], parts[at]), None, [], [], []
                if query[at]:
                    asked.append((keys[at], vectors[at]))
                    if len(asked) >= 4096:
                        yield from answer()
                else:
                    ids.append(own[at])
                    values.append(vectors[at])
        yield from answer()

    order = ["list", "part", "query"]
    ordered = table.repartition("list", "part").sortWithinPartitions(*order)
    return ordered.select(*order, "key", "ids", "value").mapInArrow(scan, "key binary, vec_id long, score double")


def nearest(vectors: DataFrame, queries: Column, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the nearest found for every id that the
    condition on vec_id names."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    kind = _kind(rows)
    drawn = packed(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample), kind)
    most_bytes, values = 64 << 20, []
    for row in drawn.select("value").toLocalIterator():
        if most_bytes < len(row.value):
            break
        most_bytes -= len(row.value)
        values.append(bytes(row.value))
    none = "query_id long, rank int, vec_id long, score double"
    if not values:
        return spark.createDataFrame([], none)
    held = spark.sparkContext.broadcast(fit(values, kind, settings))

    def assign(batches):
        import pyarrow as pa

        index = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                order = index.order(unit(matrix(part.column(1).to_pylist(), kind)))
                yield pa.record_batch(
                    [*part.columns, pa.array(order[:, 0], pa.int32())], names=[*part.schema.names, "list"]
                )

    found = classes(packed(rows, kind), queries, settings.best)
    found = found.select("key", "value", "ids", "query").mapInArrow(
        assign, "key binary, value binary, ids array<long>, query boolean, list int"
    )
    found = written(found, "vector-classes")
    # A row for each list, of which there are at most `lists`.
    sizes = {row.list: row["count"] for row in found.groupBy("list").count().collect()}
    parts = {at: -(-size // settings.part) for at, size in sizes.items()}
    enough = 4 * (settings.best + 1)

    def probe(batches):
        import pyarrow as pa

        index = held.value
        for batch in batches:
            keys, values = (c.to_pylist() for c in batch.columns)
            at, lists, of = [], [], []
            for number, order in enumerate(index.order(unit(matrix(values, kind))).tolist()):
                met = 0
                for rank, own in enumerate(order):
                    if rank >= index.probes and met >= enough:
                        break
                    met += sizes.get(own, 0)
                    for part in range(parts.get(own, 0)):
                        at.append(number)
                        lists.append(own)
                        of.append(part)
            yield pa.record_batch(
                [pa.array(lists, pa.int32()), pa.array(of, pa.int32()),
                 pa.array([keys[i] for i in at], pa.binary()), pa.array([values[i] for i in at], pa.binary())],
                names=["list", "part", "key", "value"],
            )

    split = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    candidates = found.select(
        "list", F.pmod(F.xxhash64("key"), split[F.col("list")]).cast("int").alias("part"),
        F.lit(False).alias("query"), "key", "ids", "value",
    )
    asked = found.where("query").select("key", "value").mapInArrow(
        probe, "list int, part int, key binary, value binary"
    )
    asked = asked.select(
        "list", "part", F.lit(True).alias("query"), "key", F.lit(None).cast("array<long>").alias("ids"), "value"
    )
    met = written(_scanned(candidates.union(asked), kind, held, settings), "vector-pairs")
    best = _best(met, settings.best)
    own = packed(rows.where(F.coalesce(queries, F.lit(False))), kind)
    own = own.select(F.col("vec_id").alias("query_id"), "key").distinct()
    kept = F.filter("best", lambda b: b["vec_id"] != F.col("query_id"))
    answers = own.join(best, "key").select(
        "query_id", F.posexplode(F.slice(kept, 1, settings.best)).alias("place", "found")
    )
    return answers.select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("found.vec_id").alias("vec_id"),
        F.col("found.score").alias("score"),
    )


def _best(met: DataFrame, best: int) -> DataFrame:
    """key and its best + 1 neighbours, nearest first. A key has best + 1 ids at most from each
    class that a part returned, and as many classes from each part."""
    pairs = met.select("key", F.struct((-F.col("score")).alias("far"), "vec_id", "score").alias("b")).distinct()
    # An id may be there with several vectors: the nearest counts.
    pairs = pairs.groupBy("key", F.col("b.vec_id").alias("vec_id")).agg(F.min("b").alias("b"))
    return pairs.groupBy("key").agg(
        F.slice(F.array_sort(F.collect_list("b")), 1, best + 1).alias("best")
    )
