"""Benchmark decontamination by templates; DataFrame functions only.

Texts become words with typed placeholders: numbers, names (capital letters inside a
sentence) and units after a number. Hashes of `window` such words are joined with those of the
benchmark, so a question asked again with other numbers or names still meets its item. What is
a name depends on what stands before it and on capitals, so windows of the plain lowered words
(the exact form) are joined too, and a document's window that begins with a name is also
tried with that word plain, as an item's first word is. For the
documents that meet an item, the slots are then compared: within one alignment
a slot value of the item must always stand for the same value in the document; windows with a
slot that doesn't are left out. A document is contaminated by an item if `least_cover` of the
item's words lie in the remaining windows, or do so or are equal to the document's word at their
place within one alignment. So a few changed words cost those words and not all windows over
them, as long as one window is left: two changes leave one in items of 24 words or more, three in
those of 32.

Benchmark windows with more than `most_slots` placeholders say too little as templates and are
only joined in their exact form.
Items shorter than `window` words use one window of their own length; those with fewer than
`least_words` match nothing. The joins carry no hints: the written tables of benchmark windows
tell Spark their size.

Null texts count as empty and match nothing. Rows with the same doc_id and text are one
document; with the same doc_id and other texts they are judged apart and reported together. A
null doc_id is judged too. Empty tables give no rows. Other columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.tables import fresh_name, join_on, row_key, whole_text, written

ITEM = ["item_id", "item_key"]
PAIR = ["doc_id", "text_key", *ITEM]
NAME, UNIT, NUMBER = "\x01", "\x02", "0"
# Units that count as such after a number.
UNITS = (
    "km m cm mm kg g mg t l ml h min s ms mi ft in lb oz mph kmh percent euro euros dollar dollars"
    " cent cents hour hours minute minutes second seconds day days week weeks month months year"
    " years meter meters metre metres mile miles liter liters litre litres gram grams"
).split()


@dataclass(frozen=True)
class Settings:
    window: int = 8
    most_slots: int = 4
    least_words: int = 5
    least_cover: float = 0.5


def words(text: Column) -> Column:
    """Lowered words; names and units carry a mark in front."""
    named = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;:] )(\p{Lu})", NAME + "$1")
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    marked = F.regexp_replace(named, rf"(?<=[0-9] ?)(?=(?:{units})(?!\p{{L}}))", UNIT)
    word = r"[\x01\x02]?\p{L}[\p{L}\p{M}]*+|[0-9]++(?:[.,][0-9]++)*+"
    return F.regexp_extract_all(F.lower(marked), F.lit(word), F.lit(0))


def placeholder(word: Column) -> Column:
    """The type of a slot, else the word: marks and digits sort before all letters."""
    return (
        F.when(word < UNIT, NAME).when(word < "\x03", UNIT).when(word < ":", NUMBER).otherwise(word)
    )


def plain(word: Column) -> Column:
    """The word without its mark; numbers apart from the placeholder of numbers."""
    return (
        F.when(word < "\x03", F.substring(word, 2, 1 << 30))
        .when(word < ":", F.concat(F.lit("="), word)).otherwise(word)
    )


def _windows(size: int) -> Column:
    """(place, hash) of each stretch of `size` words: of its exact form; of its template, where that
    differs, so only around slots; and, where it begins with a name, of its template with that word
    plain."""
    many = F.size("hashes") - (size - 1)
    hashes, exact = F.col("hashes"), F.col("exact")
    entry = lambda at, value: F.struct(at.alias("place"), value.alias("hash"))
    slots = F.filter(
        F.transform(hashes, lambda own, i: F.when(own != F.get(exact, i), i)), lambda i: i.isNotNull()
    )
    around = F.transform(
        slots, lambda i: F.sequence(F.greatest(i - (size - 1), F.lit(0)), F.greatest(F.least(i, many - 1), F.lit(0)))
    )
    begun = F.filter(slots, lambda i: (i < many) & (F.get(hashes, i) == F.xxhash64(F.lit(NAME))))
    every = F.concat(
        F.transform(
            F.sequence(F.lit(0), many - 1), lambda at: entry(at, F.xxhash64(F.slice(exact, at + 1, size)))
        ),
        F.transform(
            F.array_distinct(F.flatten(around)),
            lambda at: entry(at, F.xxhash64(F.slice(hashes, at + 1, size))),
        ),
        F.transform(
            begun,
            lambda at: entry(
                at, F.xxhash64(F.concat(F.array(F.get(exact, at)), F.slice(hashes, at + 2, size - 1)))
            ),
        ),
    )
    return F.when(many > 0, every)


def _placed(tokens: DataFrame, size: int, *columns: str) -> DataFrame:
    """The columns, place (from 0) and hash of all windows of a size."""
    return tokens.select(*columns, F.explode(_windows(size)).alias("window")).select(
        *columns, "window.place", "window.hash"
    )


def _hashed(rows: DataFrame, text: Column, *keys: str) -> DataFrame:
    """keys, words, their template hashes and those of their exact form."""
    return rows.select(*keys, words(text).alias("words")).select(
        *keys, "words", F.transform("words", lambda word: F.xxhash64(plain(word))).alias("exact")
    ).select(
        *keys, "words",
        F.zip_with(
            "words", "exact",
            lambda word, own: F.when(word < ":", F.xxhash64(placeholder(word))).otherwise(own),
        ).alias("hashes"),
        "exact",
    )


def _slots(at: Column, size: Column | int) -> Column:
    """Places and values of the slots in a window of the column words."""
    part = F.slice(F.col("words"), at, size)
    numbered = F.transform(part, lambda word, i: F.struct(i.alias("at"), word.alias("value")))
    return F.filter(numbered, lambda slot: slot["value"] < ":")


def _items(benchmark: DataFrame) -> DataFrame:
    """Words and hashes of the items; those with one id and other texts stay apart."""
    rows = benchmark.where(F.col("item_id").isNotNull())
    rows = rows.select("item_id", F.xxhash64(whole_text()).alias("item_key"), "text").distinct()
    return _hashed(rows, whole_text(), *ITEM)


def benchmark_windows(benchmark: DataFrame, settings: Settings) -> DataFrame:
    """item_id, item_key, size, place, hash, of (words of the item) and slots of the windows
    used, in both forms; the exact form has no slots to compare."""
    hashed = _items(benchmark).withColumn("size", F.least(F.size("words"), F.lit(settings.window)))
    hashed = hashed.where(F.col("size") >= settings.least_words)
    many = F.size("words") - F.col("size") + 1
    placed = hashed.select(
        *ITEM, "words", "hashes", "exact", "size", F.size("words").alias("of"),
        F.explode(F.sequence(F.lit(1), many)).alias("place"),
    )
    window = lambda hashes: F.xxhash64(F.slice(hashes, F.col("place"), F.col("size"))).alias("hash")
    slots = _slots(F.col("place"), F.col("size"))
    template = placed.select(*ITEM, "size", "place", "of", window("hashes"), slots.alias("slots"))
    template = template.where(F.size("slots") <= settings.most_slots)
    exact = placed.where(F.size(slots) > 0).select(
        *ITEM, "size", "place", "of", window("exact"), F.slice(slots, 1, 0).alias("slots")
    )
    return template.union(exact)


def _met(keyed: DataFrame, hashes: DataFrame, sizes: list[int]) -> DataFrame:
    """Key, place and hash of the document windows that the benchmark has."""
    out = None
    for size in sizes:
        windows = _placed(keyed, size, "doc_id", "text_key")
        wanted = hashes.where(F.col("size") == size).select("hash")
        met = windows.join(wanted, "hash").withColumn("size", F.lit(size))
        out = met if out is None else out.union(met)
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """doc_id, text_key, item_id, cover (share of the item's words found, see above)
    and reworded (a slot has another value) of every contaminated document."""
    bench = written(benchmark_windows(benchmark, settings), "benchmark-windows")
    hashes = written(bench.select("hash", "size").distinct(), "benchmark-hashes")
    # At most `window` different sizes.
    sizes = sorted(row.size for row in hashes.select("size").distinct().collect())
    if not sizes:
        sizes = [settings.window]
    keyed = docs.select(*row_key(), whole_text().alias("text"))
    met = written(_met(_hashed(keyed, F.col("text"), "doc_id", "text_key"), hashes, sizes), "met")
    suspects = written(met.select("doc_id", "text_key").distinct(), "suspects")
    texts = join_on(keyed, suspects, ["doc_id", "text_key"], "left_semi")
    # Texts are moved once; rows are told apart by their keys.
    texts = texts.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    tokens = _hashed(written(texts, "suspected-texts"), F.col("text"), "doc_id", "text_key")
    aligned = written(_met_with_slots(tokens, bench, sizes), "aligned")
    windows = written(_consistent(aligned), "consistent")
    return _covered(windows, tokens, _items(benchmark), settings)


def _met_with_slots(tokens: DataFrame, bench: DataFrame, sizes: list[int]) -> DataFrame:
    """Windows of suspects with their item's, and the slots of both."""
    out = None
    for size in sizes:
        windows = _placed(tokens, size, "doc_id", "text_key", "words").select(
            "doc_id", "text_key", "hash", (F.col("place") + 1).alias("at"),
            F.slice("words", F.col("place") + 1, size).alias("own"),
        )
        wanted = bench.where(F.col("size") == size).select("hash", *ITEM, "size", "of", "place", "slots")
        met = windows.join(wanted, "hash").select(
            *PAIR, "size", "of", "place", (F.col("at") - F.col("place")).alias("shift"),
            F.transform("slots", lambda slot: F.struct(
                slot["value"].alias("item"), F.get("own", slot["at"]).alias("doc"))).alias("slots"),
        )
        out = met if out is None else out.union(met)
    return out


def _consistent(aligned: DataFrame) -> DataFrame:
    """The windows whose slots are consistent, and whether their alignment has other values."""
    alignment = [*PAIR, "shift"]
    values = (
        aligned.select(*alignment, F.explode("slots").alias("slot"))
        .groupBy(*alignment, F.col("slot.item").alias("item"))
        .agg(F.min("slot.doc").alias("least"), F.max("slot.doc").alias("most"))
        .groupBy(*alignment)
        .agg(
            F.collect_set(F.when(F.col("least") != F.col("most"), F.col("item"))).alias("torn"),
            F.max(F.col("least") != F.col("item")).alias("other"),
        )
    )
    judged = join_on(aligned, values, alignment, "left").select(
        *alignment, "size", "of", "place",
        F.coalesce("other", F.lit(False)).alias("other"),
        F.coalesce(
            F.exists("slots", lambda slot: F.array_contains(F.col("torn"), slot["item"])), F.lit(False)
        ).alias("broken"),
    )
    return judged.where(~F.col("broken")).drop("broken")


def _covered(
    windows: DataFrame, tokens: DataFrame, items: DataFrame, settings: Settings
) -> DataFrame:
    """Pairs with enough of the item's words in windows of all alignments together, or in windows
    or equal to the document's within one."""
    together = windows.groupBy(*PAIR, "of").agg(
        F.collect_set("place").alias("places"), F.first("size").alias("size"),
        F.min("other").alias("reworded"),
    )
    single = windows.groupBy(*PAIR, "shift").agg(
        F.collect_set("place").alias("places"), F.first("size").alias("size")
    )
    inside = F.array_distinct(F.flatten(F.transform(
        "places", lambda at: F.sequence(at, at + F.col("size") - 1)
    )))
    single = single.select(*PAIR, "shift", inside.alias("inside")).join(
        items.select(*ITEM, F.col("exact").alias("wanted")), ITEM
    )
    texts = tokens.select("doc_id", "text_key", "exact")
    equal = F.filter(
        F.sequence(F.lit(1), F.size("wanted")),
        lambda at: F.get("wanted", at - 1) == F.get("exact", at - 1 + F.col("shift")),
    )
    best = (
        join_on(single, texts, ["doc_id", "text_key"])
        .select(*PAIR, F.size(F.array_union("inside", equal)).alias("words"))
        .groupBy(*PAIR).agg(F.max("words").alias("best"))
    )
    found = F.greatest(F.size(inside), F.col("best"))
    return (
        join_on(together, best, PAIR)
        .select("doc_id", "text_key", "item_id", (found / F.col("of")).alias("cover"), "reworded")
        .where(F.col("cover") >= settings.least_cover)
        .groupBy("doc_id", "text_key", "item_id")
        .agg(F.max("cover").alias("cover"), F.min("reworded").alias("reworded"))
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """The documents that no item contaminates, with their own columns."""
    found = contaminated(docs, benchmark, settings).select("doc_id", "text_key").distinct()
    name = fresh_name(docs, "found")
    found = found.select(F.struct("doc_id", "text_key").alias(name))
    on = F.col("doc_id").eqNullSafe(F.col(f"{name}.doc_id")) & (
        F.xxhash64(whole_text()) == F.col(f"{name}.text_key")
    )
    return docs.join(found, on, "left_anti")
