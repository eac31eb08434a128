"""Toxicity by a factorization machine over hashed terms.

Besides a weight for each term, the machine learns a short vector for each; the product of two
vectors is the weight of the two terms together, so an insult next to a group mention can count
for more than both alone, which additive weights can't express.

Terms are runs of letters and the beginnings of the longer ones, lowered and hashed into
`buckets`; a text has a term or hasn't, so
length does not dilute it. Only buckets that at least `least_support` texts of the sample share,
and whose share of toxic texts differs from the sample's by `least_z` standard errors, get
weights: invented and misspelt words, most of the distinct ones, would only add noise.

Training reads a bounded sample: at most `max_labelled` labelled documents (the ones with the
smallest hashes of their ids), whose term buckets go to the driver as bytes. Bound: 20,000 documents
by default, about 250 buckets of 4 bytes each. Scoring reads every text in full.

Null or empty texts have no terms and get the machine's constant as their score. Labels that
are null are not used; an id labelled twice counts as toxic if one label says so, and
of several texts with one id the last in order is learnt from. Without any
labels every score is 0. Repeated rows get equal scores. Other columns are not used.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.tables import fresh_name, whole_text

TERM = re.compile(r"[^\W\d_]+")
# Lengths of word beginnings that are terms too, so that inflected forms share weights.
STEM = (4, 6)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    factors: int = 6
    max_labelled: int = 20_000
    least_support: int = 5
    least_z: float = 3.0
    epochs: int = 15
    batch: int = 256
    rate: float = 0.1
    decay: float = 1e-3
    seed: int = 7


@dataclass
class Machine:
    """constant, weights (buckets + 1) and vectors (buckets + 1, factors); the last row of both
    is zero and stands for buckets without support, `slot` maps buckets to rows."""

    constant: float
    slot: object
    weights: object
    vectors: object

    def scores(self, starts, slots):
        """Scores of texts whose slots follow one another, the first of each at `starts`."""
        import numpy as np

        if not len(slots):
            return np.full(len(starts), 1 / (1 + np.exp(-self.constant)))
        margin = self.constant + _sums(self.weights[slots], starts)
        rows = self.vectors[slots]
        margin += 0.5 * (_sums(rows, starts) ** 2 - _sums(rows**2, starts)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _sums(values, starts):
    """Sums of stretches of values; the last value must be zero, so that stretches may be empty."""
    import numpy as np

    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
    stops = np.append(starts[1:], len(values))
    return total[stops] - total[starts]


def term_buckets(text: str, buckets: int) -> set[int]:
    """Buckets of the words of a text and of their beginnings of STEM lengths."""
    words = set(TERM.findall(text.lower()))
    stems = {word[:size] + "-" for size in STEM for word in words if len(word) > size}
    mask = buckets - 1
    return {zlib.crc32(term.encode()) & mask for term in words | stems}


def term_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """label and the sorted buckets of every text, as little-endian 32-bit integers."""

    def gather(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [sorted(term_buckets(t.as_py(), buckets)) for t in batch.column(1)]
            raw = [np.array(own, dtype="<i4").tobytes() for own in found]
            yield pa.record_batch(
                [batch.column(0), pa.array(raw, type=pa.binary())], names=["label", "buckets"]
            )

    rows = docs.select(F.col("label").cast("int").alias("label"), whole_text().alias("text"))
    return rows.mapInArrow(gather, "label int, buckets binary")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows that training must not see: crc32 of the id as text, modulo `folds`, is `fold`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> list:
    """(label, buckets as bytes) of the bounded sample."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.max_labelled)
    )
    # The sample has at most max_labelled rows of 12 bytes, so a broadcast is bounded.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    return [(row.label, bytes(row.buckets)) for row in term_rows(rows, settings.buckets).collect()]


def _raw(buckets) -> bytes:
    import numpy as np

    return buckets if isinstance(buckets, bytes) else np.array(buckets, dtype="<i4").tobytes()


def fit(sample: list, settings: Settings = Settings()) -> Machine:
    """Adaptive gradient steps on the logistic loss of the sample; buckets as bytes or numbers."""
    import numpy as np

    sample = sorted((label, _raw(buckets)) for label, buckets in sample)
    label = np.array([y for y, _ in sample], dtype=float)
    flat = np.frombuffer(b"".join(raw for _, raw in sample), dtype="<i4")
    stops = np.cumsum([len(raw) // 4 for _, raw in sample], dtype=np.int64)
    starts = np.concatenate((np.zeros(1, dtype=np.int64), stops))
    support = np.bincount(flat, minlength=settings.buckets)
    share = label.mean() if len(label) else 0.0
    toxic = np.repeat(label > 0, np.diff(starts))
    positive = np.bincount(flat[toxic], minlength=settings.buckets)
    spread = np.sqrt(np.maximum(support * share * (1 - share), 1e-9))
    telling = np.abs(positive - support * share) >= settings.least_z * spread
    used = np.flatnonzero((support >= settings.least_support) & telling)
    none = len(used)
    slot = np.full(settings.buckets, none, dtype=np.int32)
    slot[used] = np.arange(none)
    texts = [slot[flat[a:b]] for a, b in zip(starts[:-1], starts[1:])]
    texts = [np.append(slots[slots < none], none) for slots in texts]
    del sample, flat, toxic
    rng = np.random.default_rng(settings.seed)
    weights, vectors = np.zeros(none + 1), rng.normal(0, 0.02, (none + 1, settings.factors))
    vectors[none] = 0
    constant = float(np.log(max(share, 1e-12) / max(1 - share, 1e-12)))
    machine = Machine(constant, slot, weights, vectors)
    if not 0 < share < 1:
        return machine
    seen_w, seen_v = np.full(none + 1, 1e-6), np.full((none + 1, settings.factors), 1e-6)
    for _ in range(settings.epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), settings.batch):
            chosen = order[at : at + settings.batch]
            parts = [texts[i] for i in chosen]
            sizes = np.array([len(p) for p in parts])
            starts, slots = np.cumsum(sizes) - sizes, np.concatenate(parts)
            error = (machine.scores(starts, slots) - label[chosen]) / len(chosen)
            machine.constant -= 0.5 * error.sum()
            each = np.repeat(error, sizes)
            rows, places = np.unique(slots, return_inverse=True)
            step_w = np.bincount(places, each) + settings.decay * weights[rows]
            sums = np.repeat(_sums(vectors[slots], starts), sizes, axis=0)
            pull = each[:, None] * (sums - vectors[slots])
            step_v = np.stack([np.bincount(places, pull[:, k]) for k in range(settings.factors)], axis=1)
            step_v += 5 * settings.decay * vectors[rows]
            seen_w[rows] += step_w**2
            seen_v[rows] += step_v**2
            weights[rows] -= settings.rate * step_w / np.sqrt(seen_w[rows])
            vectors[rows] -= 0.2 * settings.rate * step_v / np.sqrt(seen_v[rows])
            weights[none], vectors[none] = 0, 0
    return machine


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Machine:
    return fit(labelled_sample(docs, labels, settings), settings)


def score(docs: DataFrame, machine: Machine, name: str = "score", slice_rows: int = 512) -> DataFrame:
    """All columns of the documents and their score, a double from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by `buckets`
    kinds = docs.schema
    text_at = docs.columns.index("text")

    def rate(batches):
        import numpy as np
        import pyarrow as pa

        model = held.value
        slot, none = model.slot, len(model.weights) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                rows = batch.slice(at, slice_rows)
                parts, starts, total = [], [], 0
                for text in rows.column(text_at).to_pylist():
                    hashed = term_buckets(text or "", len(slot))
                    found = slot[np.fromiter(hashed, dtype=np.int64, count=len(hashed))]
                    part = np.append(np.sort(found[found < none]), none)
                    parts.append(part)
                    starts.append(total)
                    total += len(part)
                scores = model.scores(np.array(starts), np.concatenate(parts))
                yield pa.record_batch(
                    [*rows.columns, pa.array(scores, type=pa.float64())],
                    names=[*rows.schema.names, name],
                )

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(rate, StructType([*kinds.fields, StructField(name, DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """The documents whose score is below the limit, with their own columns."""
    name = fresh_name(docs, "score")
    return score(docs, train(docs, labels), name).where(F.col(name) < limit).drop(name)
