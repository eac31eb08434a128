"""Ranked lexical search by presence masks.

Every item asks for the documents that score highest for its terms. Texts are read once: the
postings of the items' terms (term numbers and counts of each document) become a written
table, and the number of documents, of all terms and of documents with each term are
aggregated over all texts.

Postings are then ranked in blocks of documents. Each term of a block has a bitmap of the
documents that hold it. For an item, the bitmaps of its terms, turned over, give each document the mask of
the terms it matches, and documents with equal masks form a group. A group's highest possible
score follows from its mask, its shortest document and the block's highest count of each term.
Groups are evaluated by descending highest score until the k-th best score found exceeds what
the next group can reach, so the best k of each block are exact; the best k of all blocks
together are the best k of all documents.

Items are worked through in packs of about `pack_terms` terms. Only one pack is at the driver
and broadcast at a time, so its size is bounded; benchmarks of up to that size take one pass.

Terms are maximal runs of characters other than ASCII punctuation, blanks and control characters; only A-Z
are lowered. Null and empty texts have no terms and take no part. Rows with one doc_id, also equal
ones, are documents of their own, and rows with a null doc_id are ranked after equal scores with one.
Rows with one item_id are one item with the terms of all; a null item_id is an item like others.
Empty tables give no rows, as do items without terms. Other columns are not used.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.tables import whole_text, written

# ASCII characters that part terms, and those that are lowered.
_PARTS = [c for c in range(128) if not chr(c).isalnum()]
_TABLE = bytes.maketrans(
    bytes(_PARTS) + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_PARTS) + b"abcdefghijklmnopqrstuvwxyz"
)


@dataclass(frozen=True)
class Settings:
    best: int = 10
    block: int = 8192  # documents ranked together
    step: int = 64  # documents evaluated at least between two looks at the k-th best
    pack_terms: int = 50_000


@dataclass(frozen=True)
class Pack:
    """Terms of a pack of items: `numbers` of the terms, and each item's term numbers."""

    numbers: dict
    items: list


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term as binary)."""

    def gather(batches):
        import pyarrow as pa

        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(terms(text))
                ids += [item] * len(found)
                out += found
            columns = [pa.array(ids, pa.int64()), pa.array(out, pa.binary())]
            yield pa.record_batch(columns, names=["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    return rows.mapInArrow(gather, "item_id long, term binary").distinct()


def packs(items: DataFrame, pack_terms: int):
    """The items in packs of about `pack_terms` terms, one at a time."""
    table = written(item_terms(items), "item-terms")
    many = max(1, math.ceil(table.count() / pack_terms))
    pack = F.pmod(F.xxhash64("item_id"), F.lit(many))
    for number in range(many):
        chosen, numbers = {}, {}
        for row in table.where(pack == number).toLocalIterator():
            at = numbers.setdefault(bytes(row.term), len(numbers))
            chosen.setdefault(row.item_id, []).append(at)
        if chosen:
            yield Pack(numbers, list(chosen.items()))


def postings(docs: DataFrame, numbers: dict) -> DataFrame:
    """doc_id, n (all terms), and numbers and counts of the wanted terms, for texts with terms."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)  # bounded by `pack_terms`

    def gather(batches):
        import pyarrow as pa

        wanted = held.value
        for batch in batches:
            ids, sizes, found, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = terms(text)
                if own:
                    hits = Counter(map(wanted.get, own))
                    hits.pop(None, None)
                    ids.append(doc_id)
                    sizes.append(len(own))
                    found.append(list(hits.keys()))
                    counts.append(list(hits.values()))
            lists = pa.list_(pa.int32())
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(found, lists), pa.array(counts, lists)],
                names=["doc_id", "n", "terms", "counts"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(gather, "doc_id long, n long, terms array<int>, counts array<int>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def part(tf, m):
    """A term's share of a score before its weight, in whole numbers."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Block:
    """Documents of a block with their presence bitmaps, one for each term that occurs."""

    def __init__(self, m, of, term, tf):
        """m: a number for each document; of, term, tf: a posting each."""
        import numpy as np

        self.m, self.size = m, len(m)
        self.known, local = np.unique(term, return_inverse=True)
        key = local.astype(np.int64) * self.size + of
        order = np.argsort(key)
        self.key, self.tf = key[order], tf[order]
        begins = np.searchsorted(local[order], np.arange(len(self.known)))
        self.most = np.maximum.reduceat(self.tf, begins) if len(begins) else self.tf
        self.present = np.zeros((len(self.known), -(-self.size // 8)), dtype=np.uint8)
        bit = (128 >> (of & 7)).astype(np.uint8)
        np.bitwise_or.at(self.present, (local, of >> 3), bit)

    def counts(self, term, chosen):
        """Counts (terms x documents) of local terms in the chosen documents."""
        import numpy as np

        wanted = term[:, None] * self.size + chosen[None, :]
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.tf[at], 0)

    def best(self, numbers, weights, order_of, settings: Settings):
        """(documents, scores) of the best for an item; `order_of` ranks documents whose scores
        are equal."""
        import numpy as np

        none = np.zeros(0, dtype=np.int64)
        local = np.searchsorted(self.known, numbers)
        held = local < len(self.known)
        held[held] = self.known[local[held]] == numbers[held]
        local, weights = local[held].astype(np.int64), weights[held]
        if not len(local):
            return none, none
        bits = np.unpackbits(self.present[local], axis=1, count=self.size)
        words = np.zeros((self.size, -(-len(local) // 64) * 8), dtype=np.uint8)
        words[:, : -(-len(local) // 8)] = np.packbits(bits, axis=0).T
        words = words.view(np.uint64)
        masks = words[:, 0] if words.shape[1] == 1 else words.view(f"V{8 * words.shape[1]}")[:, 0]
        _, first, group = np.unique(masks, return_index=True, return_inverse=True)
        members = np.argsort(group, kind="stable")
        begins = np.concatenate(([0], np.cumsum(np.bincount(group))))
        least = np.minimum.reduceat(self.m[members], begins[:-1])
        most = self.most[local][:, None]
        reach = (bits[:, first] * weights[:, None] * part(most, least[None, :])).sum(axis=0)
        rank = np.argsort(-reach, kind="stable")
        documents, scores, at = none, none, 0
        while at < len(rank) and reach[rank[at]] > 0:
            if len(scores) == settings.best and reach[rank[at]] < scores[-1]:
                break
            chosen, many = [], 0
            while at < len(rank) and reach[rank[at]] > 0 and many < settings.step:
                g = rank[at]
                chosen.append(members[begins[g] : begins[g + 1]])
                many += len(chosen[-1])
                at += 1
            chosen = np.concatenate(chosen)
            tf = self.counts(local, chosen)
            new = (weights[:, None] * part(tf, self.m[chosen][None, :])).sum(axis=0)
            documents = np.concatenate((documents, chosen[new > 0]))
            scores = np.concatenate((scores, new[new > 0]))
            keep = np.lexsort((order_of[documents], -scores))[: settings.best]
            documents, scores = documents[keep], scores[keep]
        return documents, scores


def _best_of_blocks(table: DataFrame, pack: Pack, total: tuple, holding: dict, settings: Settings):
    """item_id, doc_id, score: the best of each block for each item."""
    weights = [weight(total[0], holding.get(number, 0)) for number in range(len(pack.numbers))]
    # Bounded by `pack_terms`: term numbers of the items and a weight for each term.
    held = table.sparkSession.sparkContext.broadcast((pack.items, weights))

    def rank(batches):
        import numpy as np
        import pyarrow as pa

        items, weights = held.value
        weights = np.array(weights, dtype=np.int64)
        items = [(item, np.array(sorted(own), dtype=np.int64)) for item, own in items]
        for batch in batches:
            for at in range(0, batch.num_rows, settings.block):
                rows = batch.slice(at, settings.block)
                n = rows.column(1).to_numpy()
                found = [np.concatenate([np.zeros(0, np.int64), c.flatten().to_numpy()]) for c in rows.columns[2:4]]
                sizes = rows.column(2).value_lengths().to_numpy()
                of = np.repeat(np.arange(len(n)), sizes)
                block = Block(10 + (90 * n * total[0]) // total[1], of, *found)
                ids = rows.column(0)
                least_first = np.argsort(np.argsort(ids.fill_null(0).to_numpy(), kind="stable"))
                order_of = np.where(ids.is_null().to_numpy(False), len(n) + least_first, least_first)
                out_items, out_docs, out_scores = [], [], []
                for item, own in items:
                    documents, scores = block.best(own, weights[own], order_of, settings)
                    out_items += [item] * len(documents)
                    out_docs.append(documents)
                    out_scores.append(scores)
                yield pa.record_batch(
                    [pa.array(out_items, pa.int64()), ids.take(pa.array(np.concatenate(out_docs))),
                     pa.array(np.concatenate(out_scores))],
                    names=["item_id", "doc_id", "score"],
                )

    return table.mapInArrow(rank, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's best documents."""
    out = None
    for pack in packs(items, settings.pack_terms):
        table = written(postings(docs, pack.numbers), "postings")
        total = table.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not total.n:
            continue
        # At most `pack_terms` rows.
        counted = table.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        holding = {row.term: row["count"] for row in counted}
        found = written(
            _best_of_blocks(table, pack, (total.n, total.l), holding, settings), "block-best"
        )
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        out.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= settings.best)
        .select("item_id", "rank", "doc_id", "score")
    )
