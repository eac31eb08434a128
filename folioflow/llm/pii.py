"""Personal data: fixed patterns, and contexts learnt from what they find; DataFrame functions only.

The fixed patterns give base spans of four kinds. The two words before a span are a lexical
pattern for its kind. Patterns and values form a graph: a pattern's confidence for a kind is the
smoothed share of its distinct values of the kind's form that are known as that kind, a value's
confidence that of its patterns taken together (noisy or). Values that reach `accept` become known and the
scores are computed again, `rounds` times. Then candidates with an accepted value, behind a pattern
that reaches `accept` itself, become spans too. Base spans always stay.

Candidates stand outside base spans. For email they are address-like texts, written with @, [at], (at)
or " at "; for the other kinds numbers in groups, colon groups, and runs of letters and digits. The
words of a pattern come from the text; a match of the same sort counts as one word, named by its sort,
and the start of a text as "^".

Every match is a row. Positions are running sums, in the order of matches, over the lengths of the
pieces between them, so a text with very many matches costs in proportion. Offsets are code points,
ends exclusive. Null texts count as empty; repeated rows get equal results; rows with one
doc_id and other texts are kept apart. Empty tables give no rows. Other columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.tables import join_on, row_key, whole_text, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# What follows cannot give back characters, and a match can't begin inside a run that has
# failed from its first character, except right after a match; so long runs are read once.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts without these can't hold a match.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_AT = r"(?:@|\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?)"
_DOT = r"(?:\.|\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?|\x20(?i:dot)\x20)"
_NAME = rf"{_LOCAL}++(?:\x20(?i:dot)\x20{_LOCAL}++)*+"
# Candidates, by the first form that fits where they begin.
_FORMS = (
    rf"{_NAME}{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)*+",
    rf"{_NAME}\x20(?i:at)\x20{_LABEL}++(?:{_DOT}{_LABEL}++)++",
    r"[0-9A-Fa-f]*+(?:::?[0-9A-Fa-f]++){2,}+",
    r"[+(]{0,2}+(?:[A-Z]{2}(?=[0-9]))?+[0-9]++(?:[\x20()./-]{1,3}+[0-9]++)*+(?![A-Za-z0-9_%@])",
    r"(?=[A-Za-z._%+-]*+[0-9])(?:[A-Za-z0-9]|[._%+-]++(?=[A-Za-z0-9]))++",
)
CANDIDATE = rf"(?:\G|(?<![A-Za-z0-9._%+@-]))(?:{'|'.join(_FORMS)})"
_ADDRESS_LIKE = r"@|[\x20\[({](?i:at)[\x20\])}]"
_SORTS = {**PATTERNS, "other": CANDIDATE}
# Signs that end a word of a context, besides the space.
_BREAKS = "\t\n\x0b\x0c\r\"'("


@dataclass(frozen=True)
class Settings:
    rounds: int = 3
    least_known: int = 3  # distinct known values that a pattern must have
    smoothing: float = 1.0
    accept: float = 0.5  # more likely than not
    least_digits: int = 3  # of a candidate that is no address; the shortest phone numbers have three


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _matches(docs: DataFrame) -> DataFrame:
    """One row a match: doc_id, text_key, sort, at (order), gap (code points since the match before
    it), value, and the two words before it in its piece, near and far, empty where there is none."""
    rows = docs.select(*row_key(), whole_text().alias("text"))
    none = F.array().cast("array<struct<sort:string,piece:string,value:string>>")
    digit = F.col("text").rlike("[0-9]")
    cut = []
    for sort, pattern in _SORTS.items():
        need = _NEEDS.get(sort)
        may = F.contains("text", F.lit(need)) if need else digit
        if sort == "other":
            may = digit | F.col("text").rlike(_ADDRESS_LIKE)
        elif need != "@":
            may = may & digit
        parts = F.zip_with(
            F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)),
            lambda piece, value: F.struct(
                F.lit(sort).alias("sort"), piece.alias("piece"), value.alias("value")
            ),
        )
        cut.append(F.when(may, parts).otherwise(none))
    parts = rows.select("doc_id", "text_key", F.posexplode(F.concat(*cut)).alias("at", "part"))
    said = F.rtrim(F.translate(F.lower("part.piece"), _BREAKS, " " * len(_BREAKS)))
    return (
        parts.where("part.value is not null")
        .select("doc_id", "text_key", "at", "part.sort", "part.value",
                F.length("part.piece").alias("gap"), said.alias("said"))
        .withColumn("near", F.substring_index("said", " ", -1))
        .withColumn("said", F.rtrim(F.left("said", F.length("said") - F.length("near"))))
        .withColumn("far", F.substring_index("said", " ", -1))
        .drop("said")
    )


def _placed(matches: DataFrame) -> DataFrame:
    """(doc_id, text_key, kind, first, last, value, left) of all valid matches; kind is "other" for
    candidates. The rows of a text meet in one group, which is no longer than the text."""
    key = ["doc_id", "text_key"]
    once = matches.repartition(*key).dropDuplicates([*key, "at"])
    order = Window.partitionBy(*key, "sort").orderBy("at")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.lag(F.concat(F.lit("<"), "sort", F.lit(">")), 1, "^").over(order)
    rows = (
        once.withColumn("last", F.sum(F.col("gap") + F.length("value")).over(sofar).cast("int"))
        .withColumn("mark", mark)
        .withColumn("one", F.when(F.col("near") != "", F.col("near")).otherwise(F.col("mark")))
        .withColumn("earlier", F.lag("one", 1, "^").over(order))
    )
    two = (
        F.when(F.col("far") != "", F.col("far")).when(F.col("near") != "", F.col("mark"))
        .otherwise(F.col("earlier"))
    )
    valid = F.col("sort") == "other"
    for kind in KINDS:
        valid = valid | ((F.col("sort") == kind) & _valid(kind, F.col("value")))
    return rows.where(valid).select(
        *key, F.col("sort").alias("kind"), (F.col("last") - F.length("value")).alias("first"),
        "last", "value", F.concat_ws(" ", two, "one").alias("left"),
    )


def _written_as_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ","
    )


def _outside(spans: DataFrame, settings: Settings) -> DataFrame:
    """The spans without candidates that a base span touches or that have too few digits."""
    base = F.col("kind") != "other"
    rows = Window.partitionBy("doc_id", "text_key")
    sofar = (Window.unboundedPreceding, Window.currentRow)
    onwards = rows.orderBy("first", F.when(base, 0).otherwise(1)).rowsBetween(*sofar)
    backwards = rows.orderBy(F.desc("first")).rowsBetween(*sofar)
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    free = (
        (F.coalesce("reached", F.lit(0)) <= F.col("first"))
        & (F.coalesce("ahead", "last") >= F.col("last"))
        & (F.col("value").rlike(_ADDRESS_LIKE) | (digits >= settings.least_digits))
    )
    return (
        spans.withColumn("reached", F.max(F.when(base, F.col("last"))).over(onwards))
        .withColumn("ahead", F.min(F.when(base, F.col("first"))).over(backwards))
        .where(base | free)
        .drop("reached", "ahead")
    )


def _form(value: Column) -> Column:
    """Whether a value is address-like: such ones compete for email, all others for the other kinds."""
    return value.rlike(_ADDRESS_LIKE)


def learnt(spans: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Accepted values (kind, value) and patterns (kind, left), after the rounds."""
    edges = spans.select("kind", "value", "left")
    # Only patterns that precede enough different known values can ever be believed.
    able = (
        edges.where("kind != 'other'").groupBy("left", "kind").agg(F.count_distinct("value").alias("n"))
        .where(F.col("n") >= settings.least_known).select("left").distinct()
    )
    edges = written(edges.distinct().join(able, "left"), "pii-edges")
    known = edges.where("kind != 'other'").select("kind", "value").distinct()
    pairs = edges.select("left", "value").distinct()
    total = (
        pairs.groupBy("left", _form(F.col("value")).alias("form")).agg(F.count("*").alias("total"))
    )
    form = F.col("kind") == "email"
    patterns = None
    for _ in range(settings.rounds):
        known = written(known, "pii-known")
        scored = (
            pairs.join(known, "value").groupBy("left", "kind").agg(F.count("*").alias("hits"))
            .where(F.col("hits") >= settings.least_known).withColumn("form", form)
            .join(total, ["left", "form"])
            .select("left", "kind",
                    (F.col("hits") / (F.col("total") + settings.smoothing)).alias("confidence"))
        )
        patterns = written(scored, "pii-patterns")
        doubt = F.exp(F.sum(F.log1p(-F.col("confidence"))))
        believed = (
            pairs.join(patterns, "left").where(_form(F.col("value")) == form)
            .groupBy("kind", "value").agg((1 - doubt).alias("confidence"))
            .where(F.col("confidence") >= settings.accept).select("kind", "value")
        )
        known = known.union(believed).distinct()
    trusted = patterns.where(F.col("confidence") >= settings.accept).select("kind", "left")
    return written(known, "pii-known"), trusted


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, counts of base spans, base (their text), and spans (text of all)."""
    spans = written(_outside(_placed(_matches(docs)), settings), "pii-spans")
    known, trusted = learnt(spans, settings)
    is_base = F.col("kind") != "other"
    added = (
        spans.where(~is_base).drop("kind").join(trusted, "left").join(known, ["kind", "value"])
        .select("doc_id", "text_key", "kind", "first", "last", F.lit(False).alias("base"))
    )
    own = spans.where(is_base).select(
        "doc_id", "text_key", "kind", "first", "last", F.lit(True).alias("base")
    )
    rank = F.array_position(F.array(*[F.lit(kind) for kind in KINDS]), F.col("kind"))
    span = F.struct(rank.alias("rank"), "first", "last", "kind")
    found = (
        own.union(added).groupBy("doc_id", "text_key")
        .agg(
            *[F.count_if(F.col("base") & (F.col("kind") == kind)).alias(f"n_{kind}") for kind in KINDS],
            F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"),
            F.array_sort(F.collect_list(span)).alias("spans"),
        )
    )
    return join_on(docs.select(*row_key()), found, ["doc_id", "text_key"], "left").select(
        "doc_id",
        *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        *[F.coalesce(_written_as_text(F.col(name)), F.lit("")).alias(name) for name in ("base", "spans")],
    )
