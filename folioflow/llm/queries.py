"""Named queries over the given tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import (
    conversations, decontaminate, line_dedup, near_dedup, neighbours, packing, pii, quality,
    ranked_search, substrings, token_orc, toxicity, url_filter,
)
from folioflow.llm.tables import given, shared_folder, whole_text


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-orc")
    token_orc.write_tokens(
        given(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=2
    )
    return token_orc.token_digest(token_orc.read_tokens(spark, path))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = packing.Settings(tokenizer_file("word_bpe_49k.json"), end_id=1, word_level=True)
    return packing.pack(given(spark, sf_dir, "documents"), settings)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each contaminated document and item."""
    docs, benchmark = (given(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = decontaminate.contaminated(docs, benchmark)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("cover").alias("cover"), F.min("reworded").alias("reworded")
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(given(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[f"n_{kind}" for kind in pii.KINDS],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
    )


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(given(spark, sf_dir, "documents"), digest=True)
    return left.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256")
    )


# The rules that op6 is given.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(given(spark, sf_dir, "pages"), URL_RULES)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(given(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(given(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = line_dedup.keep_bitmaps(docs)
    counted = docs.withColumn("n_lines", F.size(F.split(whole_text(), "\n", -1)).cast("long"))
    kept = line_dedup.drop_lines(counted, bitmaps, count="n_dropped")
    digest = F.sha2(whole_text().cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (given(spark, sf_dir, name) for name in ("documents", "labels"))
    machine = toxicity.train(docs, labels)
    scored = toxicity.score(docs.select("doc_id", "text"), machine)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(given(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (given(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return ranked_search.search(docs, benchmark)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given_turns = given(spark, sf_dir, "conversations")
    return conversations.report(conversations.repair(conversations.damaged(given_turns)), given_turns)


QUERIES = {
    "op1_token_orc": op1_token_orc,
    "op2_packing": op2_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_pii": op4_pii,
    "op5_substrings": op5_substrings,
    "op6_url_filter": op6_url_filter,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_neighbours": op11_neighbours,
    "op12_ranked_search": op12_ranked_search,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE = {
    "op9_line_dedup": """
        with lines as (
            select doc_id, row_id, unnest(string_split(text, chr(10))) as line,
                   generate_subscripts(string_split(text, chr(10)), 1) as position
            from (select doc_id, coalesce(text, '') as text, row_number() over () as row_id
                  from documents)
        ), keyed as (
            select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz'),
                           ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line_key
            from lines
        ), keys as (
            select line_key, max(doc_id) as keeper from keyed where length(line_key) >= 20
            group by line_key having count(distinct doc_id) >= 3
        ), marked as (
            select k.*, keeper is not null and doc_id < keeper as dropped
            from keyed k left join keys using (line_key)
        )
        select doc_id, count(*) as n_lines,
               cast(sum(case when dropped then 1 else 0 end) as bigint) as n_dropped,
               sha256(coalesce(string_agg(case when not coalesce(dropped, false) then line end,
                                          chr(10) order by position), '')) as kept_sha256
        from marked group by row_id, doc_id
    """,
    "op12_ranked_search": r"""
        with doc_terms as (
            select row_id, doc_id, unnest(own) as term, len(own) as n
            from (select row_number() over () as row_id, doc_id,
                         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                      'abcdefghijklmnopqrstuvwxyz'),
                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as own
                  from documents)
        ), item_terms as (
            select distinct item_id,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                       'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from benchmark
        ), total as (
            select count(distinct row_id) as docs, count(*) as terms from doc_terms
        ), counts as (
            select row_id, doc_id, n, term, count(*) as tf from doc_terms
            where term in (select term from item_terms) group by all
        ), weights as (
            select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w
            from counts, total group by term
        ), scores as (
            select item_id, row_id, doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) as score
            from item_terms join counts using (term) join weights using (term), total
            group by all
        ), ranked as (
            select *, row_number() over (partition by item_id
                                         order by score desc, doc_id nulls last) as place
            from scores where score > 0
        )
        select item_id, cast(place as integer) as rank, doc_id, cast(score as bigint) as score
        from ranked where place <= 10
    """,
}
