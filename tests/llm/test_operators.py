"""Every text operator on odd rows, on empty tables and on a given table, against brute force."""

import random
import sys
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import folioflow  # noqa: E402
from folioflow.llm import (  # noqa: E402
    decontaminate, line_dedup, near_dedup, packing, pii, quality, substrings, token_orc, toxicity,
    url_filter,
)
from folioflow.llm.queries import QUERIES, URL_RULES, tokenizer_file  # noqa: E402
from folioflow.llm.tables import shared_folder  # noqa: E402

cloudpickle.register_pickle_by_value(folioflow)
FOLDER = "/root/testdata/sf0.001"

_rng = random.Random(3)
_vocabulary = ["".join(_rng.choices("abcdefghij", k=_rng.randint(2, 8))) for _ in range(400)]
LONG = " ".join(_rng.choices(_vocabulary, k=900))
PASSAGE = " ".join(_rng.choices(_vocabulary, k=70))
LINE = "This line is said in three documents or more."


def _edited(text, every):
    return " ".join("x" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


ODD = [
    (1, "Some words, 42 of them: äöü ß – “quoted”."),
    (2, None), (3, ""), (4, " "), (None, "No id here at all"), (None, None), (5, "one"),
    (6, LONG), (7, LONG), (7, LONG), (8, _edited(LONG, 250)), (9, _edited(LONG, 60)),
    (10, LONG + " " + LONG), (11, "start " + PASSAGE + " end"), (12, PASSAGE.upper()),
    (13, "other\n" + PASSAGE + "\ntext"), (14, f"a\n{LINE}\nb"), (15, f"  {LINE.upper()}\t\nb\n"),
    (16, f"{LINE}\n{LINE}\n\n"), (17, f"c\n{LINE}"), (18, "a  b\n\n c\td <|endoftext|> \x01 e\u3000f"),
    (19, "same id one two three"), (19, "same id four five six"), (20, "x" * 5000),
    (21, "mail a.b@c.de, b@c@d.org 10.0.0.1 300.1.1.1 4111 1111 1111 1111 +49 (30) 1234-567 é"),
    (22, "1.2.3.4.5.6.7.8 4111111111111112 +1 2 user@host.com_x@y.z"), (23, "word " * 300),
    (24, "\n".join(["|#|"] * 3 + ["text"] * 2)),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with further columns, some of them named like inner ones."""
    rows = [(i, t, "en", "mark", 3, 0.5, 9) for i, t in ODD]
    schema = "doc_id long, text string, lang string, mark string, n_dropped int, score double, _id int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def ids_and_texts(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def key(row):
    return tuple((v is not None, v) for v in row)


def same(found, wanted):
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)


@pytest.mark.parametrize("table", ["odd", "given"])
def test_tokens_round_trip(spark, table, request):
    docs = request.getfixturevalue(table)
    path = shared_folder(spark, "test")
    token_orc.write_tokens(docs, path, tokenizer_file("byte_bpe_50k.json"), 2)
    files = token_orc.read_tokens(spark, path)
    rows = token_orc.token_digest(files).orderBy("start").collect()
    wanted = ids_and_texts(docs)
    ids = brute.encode("byte_bpe_50k.json", [t or "" for _, t in wanted], 2)
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows],
         [(i, len(x), brute.crc(x)) for (i, _), x in zip(wanted, ids)])
    assert [r.doc_id for r in rows] == sorted((i for i, _ in wanted), key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    found = token_orc.find_tokens(spark, path, [6]).collect()
    assert [list(r.ids) for r in found] == [x.tolist() for (i, _), x in zip(wanted, ids) if i == 6]


@pytest.mark.parametrize("table", ["odd", "given"])
def test_packing(spark, table, request):
    docs = request.getfixturevalue(table)
    settings = packing.Settings(tokenizer_file("word_bpe_49k.json"), 1, True, capacity=512)
    rows = packing.pack(docs, settings).toPandas()
    wanted = []
    texts = ids_and_texts(docs)
    for (i, _), ids in zip(texts, brute.encode("word_bpe_49k.json", [t or "" for _, t in texts], 1)):
        for piece, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            wanted.append((i, piece, at, len(part), brute.crc(part)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    found = rows[columns].astype(object).where(rows[columns].notna(), None)
    same(found.itertuples(index=False), wanted)
    rows = rows.sort_values(["sequence_id", "offset"])
    end = rows.offset + rows.length
    assert (rows.offset == end.groupby(rows.sequence_id).shift().fillna(0)).all()
    assert end.max() <= 512
    bound = -(-rows.length.sum() // 512)
    assert rows.sequence_id.nunique() <= 1.05 * bound + 2


@pytest.mark.parametrize("table", ["odd", "given"])
def test_near_duplicates(table, request):
    docs = request.getfixturevalue(table)
    texts = ids_and_texts(docs)
    roots = brute.components(texts)
    wanted = [
        (i, len(brute.shingles(t or "")), None if i is None else roots[i], i is None or roots[i] == i)
        for i, t in texts
    ]
    same(near_dedup.near_duplicates(docs).collect(), wanted)


def test_near_duplicates_in_one_crowded_bucket(spark):
    """Copies that differ from each other too much, but not from the text they come from."""
    base = LONG.split(" ")
    texts = [(100, LONG)]
    for n in range(40):
        copy = list(base)
        for k in range(14):
            copy[(n * 61 + k * 64) % 900] = f"new{n}x{k}"
        texts.append((n, " ".join(copy)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    settings = near_dedup.Settings(block=16)
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, settings).collect()}
    assert found == brute.components(texts)


@pytest.mark.parametrize("count", [200, 500])
def test_near_duplicates_of_one_template(spark, monkeypatch, count):
    """Texts of one template with similarity 0.7 stay in crowded buckets, but hardly any of their
    full sets meet there; near copies among them are found."""
    base = LONG.split(" ")[:300]
    texts = []
    for n in range(count):
        words = base[:120] + [f"own{n}x{k}" for k in range(48)] + base[168:]
        texts.append((n, " ".join(words)))
        if n % 50 == 0:
            texts.append((1000 + n, " ".join(words[:290] + ["another", "end"])))
    rows = {}
    keep = near_dedup.written

    def counted(table, name):
        table = keep(table, name)
        rows[name] = table.count()
        return table

    monkeypatch.setattr(near_dedup, "written", counted)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    settings = near_dedup.Settings(block=64)
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, settings).collect()}
    assert found == brute.components(texts)
    assert sum(i != c for i, c in found.items()) == count // 50
    assert rows["open-rows"] > count and rows["open-texts"] < count // 20


@pytest.mark.parametrize("table", ["odd", "given"])
@pytest.mark.parametrize("settings", [
    substrings.Settings(), substrings.Settings(stretch=300, block=1, batch=10),
    substrings.Settings(length=40, gram=10),
])
def test_substrings(table, settings, request):
    docs = request.getfixturevalue(table)
    if table == "given" and settings.length == 40:
        docs = docs.where("doc_id < 60")
    texts = ids_and_texts(docs)
    wanted = brute.kept_bytes([t for _, t in texts], settings.length)
    found = substrings.remove_repeats(docs, settings).collect()
    same([(*r[:4], bytes(r.kept)) for r in found], [(i, *w) for (i, _), w in zip(texts, wanted)])


@pytest.mark.parametrize("table", ["odd", "given"])
def test_lines(table, request):
    docs = request.getfixturevalue(table)
    texts = ids_and_texts(docs)
    kept = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs), "dropped_now")
    found = [(r.doc_id, r.dropped_now, r.text or "") for r in kept.collect()]
    same(found, [(i, n, t) for (i, _), (_, n, t) in zip(texts, brute.kept_lines(texts))])
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_lines_beyond_one_word_of_bits(spark):
    text = "\n".join(f"line number {n} of a very long list" for n in range(200))
    rows = [(i, text + ("" if i else "\nmine only, which stays where it is")) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert kept == {0: "mine only, which stays where it is", 1: "", 2: "", 3: text}


@pytest.mark.parametrize("table", ["odd", "given"])
def test_personal_data(table, request):
    docs = request.getfixturevalue(table)
    found = pii.find(docs).collect()
    texts = ids_and_texts(docs)
    same([(r.doc_id, r.base) for r in found],
         [(i, ",".join(brute.personal(t))) for i, t in texts])
    for r in found:
        assert set(r.base.split(",")) <= set(r.spans.split(","))


def test_personal_data_learns_contexts(spark):
    """Five numbers behind one phrase make it a pattern; what follows it elsewhere is found."""
    rows = [(n, f"please call me +49 30 1234{n}56 soon") for n in range(9)]
    rows += [(50, "please call me 0049.30.1234756 soon"), (51, "chapter 1234.5678 of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert spans[50] == "phone:15:30" and spans[51] == ""


def test_personal_data_learns_every_form(spark):
    """Candidates need neither digits nor words of their own piece, wherever the pattern stands."""
    rows = [(n, f"please call me +49 30 1234{n}56 or mail to person{n}@firm.org now") for n in range(9)]
    unseen = {
        50: ("please call me ", "030 1234 567", " today", "phone"),
        51: ("call me ", "(030) 1234-567", "", "phone"),
        52: ("write mail to ", "user@localhost", ".", "email"),
        53: ("write mail to ", "jane.doe[at]firm.org", ", soon", "email"),
        54: ("mail to ", "jane dot doe at firm dot org", "", "email"),
        55: ("x" * 3000 + " call me\n\t ", "0049.30.1234756", "", "phone"),
        56: ("call me ", "112", "", "phone"),
    }
    rows += [(n, before + value + after) for n, (before, value, after, _) in unseen.items()]
    rows += [(70, "chapter 030 1234 567 of it"), (71, "meet user@localhost there"), (72, "call me later")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    for n, (before, value, _, kind) in unseen.items():
        assert spans[n] == f"{kind}:{len(before)}:{len(before) + len(value)}", n
    assert [spans[n] for n in (70, 71, 72)] == ["", "", ""]


def test_personal_data_contexts_at_the_start_and_after_matches(spark):
    """The start of a text and a match of the same sort stand for words of a pattern."""
    rows = [(n, f"tel +49 30 1234{n}56 / +49 40 7654{n}21") for n in range(9)]
    rows += [(50, "tel 030 1234567")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {r.doc_id: (r.n_phone, r.spans) for r in found}
    assert spans[50] == (0, "phone:4:15") and spans[0] == (2, "phone:4:18,phone:21:35")


def test_personal_data_recall(spark):
    """Of planted identifiers that no fixed pattern knows, nine in ten are found, and no other number."""
    rng = random.Random(9)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    words = lambda: " ".join(rng.choices(_vocabulary, k=rng.randint(3, 60)))
    behind = {
        "phone": ["call me at", "my number is", "phone or fax:"],
        "email": ["mail me at", "write to", "my address is"],
        "ip": ["log in from", "server ip is"],
    }
    seed = {
        "phone": lambda: f"+49 {digits(3)} {digits(7)}",
        "email": lambda: f"{rng.choice(_vocabulary)}.{digits(2)}@firm.org",
        "ip": lambda: f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
    }
    new = {
        "phone": [lambda: f"0{digits(2)} {digits(4)} {digits(3)}", lambda: f"(0{digits(3)}) {digits(6)}",
                  lambda: digits(11), lambda: f"0{digits(3)}/{digits(6)}"],
        "email": [lambda: f"{rng.choice(_vocabulary)}@localhost",
                  lambda: f"{rng.choice(_vocabulary)}{digits(3)}[at]firm.org"],
        "ip": [lambda: f"fe80::{digits(3)}:{digits(4)}", lambda: f"10-{digits(2)}-{digits(3)}-{digits(2)}"],
    }
    rows, planted = [], {}
    for n in range(900):
        kind = rng.choice(list(behind))
        value = seed[kind]()
        rows.append((n, f"{words()} {rng.choice(behind[kind])} {value} {words()}"))
    for n in range(1000, 1300):
        kind = rng.choice(list(behind))
        value, before = rng.choice(new[kind])(), f"{words()} {rng.choice(behind[kind])} "
        rows.append((n, f"{before}{value} {words()}"))
        planted[n] = f"{kind}:{len(before)}:{len(before) + len(value)}"
    rows += [(n, f"{words()} in {digits(4)} and {digits(3)} {digits(4)} {words()}") for n in range(2000, 2300)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {r.doc_id: r.spans for r in found}
    recall = sum(spans[n] == wanted for n, wanted in planted.items()) / len(planted)
    print("recall of unseen identifiers", recall)
    assert recall >= 0.9
    assert not any(spans[n] for n in range(2000, 2300))


def test_personal_data_many_matches(spark):
    """A text of 100,000 matches costs in proportion, and so do a very long number and word."""
    text = " ".join(f"10.0.{n % 256}.{n // 256 % 256} or" for n in range(100_000))
    rows = [(1, text), (1, text), (2, "7 " * 200_000), (3, "a" * 500_000), (4, "a.1@" * 50_000)]
    begin = time.time()
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_ip) for r in found) == [(1, 100_000), (1, 100_000), (2, 0), (3, 0), (4, 0)]
    assert time.time() - begin < 60
    wanted = ",".join(brute.personal(text[:2000])[:90])
    assert all(r.spans.startswith(wanted) for r in found if r.doc_id == 1)


@pytest.mark.parametrize("table", ["odd", "given"])
def test_quality(table, request):
    docs = request.getfixturevalue(table)
    texts = ids_and_texts(docs)
    found = quality.judge(docs).collect()
    same([tuple(r)[:6] for r in found], [(i, *brute.quality(t)) for i, t in texts])
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_rejects_extremes_only(spark):
    noise = "".join(chr(33 + random.Random(n).randrange(90)) + " " * (n % 9 == 0) for n in range(6000))
    rows = [(1, LONG), (2, "".join(c * 2 for c in "abcdefgh ") * 300), (3, noise)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert kept == {1: True, 2: False, 3: False}


def test_toxicity(spark, odd, given, none):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    machine = toxicity.train(given, labels)
    for docs in (odd, given, none):
        scored = toxicity.score(docs, machine, "toxic_score")
        assert scored.columns == [*docs.columns, "toxic_score"]
        rows = scored.collect()
        assert len(rows) == docs.count() and all(0 <= r.toxic_score <= 1 for r in rows)
    unlabelled = toxicity.train(odd, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score(odd.drop("score"), unlabelled).collect()} == {0.0}
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_toxicity_learns_pairs():
    """A pair of terms is toxic, each alone is not: additive weights can't tell."""
    def text(n):
        return f"common words {'blorp' if n & 1 else 'house'} {'zug' if n & 2 else 'tree'} w{n % 7}"

    rng = random.Random(1)
    sample = []
    for _ in range(3000):
        n = rng.randrange(28)
        toxic = int(n & 3 == 3)
        sample.append((toxic, sorted(toxicity.term_buckets(text(n), 1 << 12))))
    settings = toxicity.Settings(buckets=1 << 12, epochs=40, decay=1e-5)
    machine = toxicity.fit(sample, settings)
    import numpy as np

    none = len(machine.weights) - 1
    for n in range(4):
        slots = machine.slot[np.array(sorted(toxicity.term_buckets(text(n), 1 << 12)))]
        slots = np.append(slots[slots < none], none)
        assert (machine.scores(np.array([0]), slots)[0] >= 0.3) == (n == 3)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op10_toxicity"](spark, folder).toPandas().merge(labels, on="doc_id")
    unseen = rows[rows.held_out]
    caught = unseen[unseen.toxic == 1].predicted.mean()
    wrong = unseen[unseen.toxic == 0].predicted.mean()
    assert caught > 0.8 and wrong < 0.01


def test_decontamination(spark, odd, none):
    items = [(1, PASSAGE), (2, None), (3, ""), (4, "too short"), (5, "five words are just enough"),
             (None, LONG), (6, "A train leaves at 9 and goes 80 km to Berlin, then Anna counts 12 bags of rice.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = spark.createDataFrame(
        [(60, "So: a train leaves at 7 and goes 95 km to Paris, then Otto counts 30 bags of rice. End"),
         (61, "a train leaves at 7 and goes to school"), (62, "they say five words are just enough for it")],
        "doc_id long, text string",
    )
    docs = odd.select("doc_id", "text").union(extra)
    found = decontaminate.contaminated(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id): r.reworded for r in found}
    assert pairs == {(11, 1): False, (12, 1): False, (13, 1): False, (60, 6): True, (62, 5): False}
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def test_decontamination_needs_consistent_slots(spark):
    bench = spark.createDataFrame(
        [(1, "you put 5 red and 7 blue in 5 rows with 7 each so 5 times 7 is asked")],
        "item_id long, text string",
    )
    docs = spark.createDataFrame(
        [(1, "you put 3 red and 4 blue in 3 rows with 4 each so 3 times 4 is asked"),
         (2, "you put 1 red and 2 blue in 6 rows with 8 each so 9 times 3 is asked")],
        "doc_id long, text string",
    )
    assert [r.doc_id for r in decontaminate.contaminated(docs, bench).collect()] == [1]


def test_given_benchmark_passages(spark, given):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    wanted = {(i, j) for i, t in ids_and_texts(given) for j, u in items if u in t}
    found = QUERIES["op3_decontaminate"](spark, FOLDER).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted


URLS = [
    (1, "https://A.Example.ORG/es/x"), (2, "http://example.org/en/12?q"), (3, "http://example.org/en/2"),
    (4, "x.com/fr/"), (5, None), (6, ""), (7, "http://notorg/"), (8, "http://org#a"), (9, "ftp://b.com/fr/1#f"),
    (10, "http://b.com/de/1"), (10, "http://b.com/de/1"), (None, "http://b.com/en/a/b/c/d/e/f/g/h"),
    (11, "a://b://c/d"), (12, "http://ÄÖ.net/P/Q?x://y"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(*u, "h", 0.1) for u in URLS],
                                  "page_id long, url string, host string, purity double")
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, URL_RULES).collect()}
    wanted = {
        (1, "a.example.org", "/es/x", "example.org/es/", "block"),
        (2, "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "example.org", "/en/2", "org/", "allow"), (4, "", "", None, "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "notorg", "/", None, "allow"),
        (8, "org", "", None, "allow"), (9, "b.com", "/fr/1", "com/fr/", "allow"),
        (10, "b.com", "/de/1", "com/de/", "block"),
        (None, "b.com", "/en/a/b/c/d/e/f/g/h", None, "allow"), (11, "b:", "//c/d", None, "allow"),
        (12, "ÄÖ.net", "/P/Q", None, "allow"),
    }
    assert found == wanted
    assert url_filter.judge(pages, URL_RULES).count() == len(URLS)
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0


def test_url_templates_learn_from_rules(spark):
    """Unlabelled pages of a branch whose labelled ones are nearly all blocked are blocked."""
    rows = [(n, f"http://s.com/shop/bad{n % 3}/{n}") for n in range(300)]
    rows += [(1000 + n, f"http://s.com/shop/ok/{n}") for n in range(300)]
    rows += [(2000, "http://s.com/shop/other/1")]
    rules = [url_filter.Rule("block", "s.com", "/shop/bad0"), url_filter.Rule("block", "s.com", "/shop/bad1/1"),
             url_filter.Rule("allow", "s.com", "/shop/ok/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = url_filter.judge(pages, rules).where("rule is null").groupBy("template", "verdict").count()
    verdicts = {r.template: r.verdict for r in found.collect()}
    assert verdicts == {"/shop/bad#/#": "block", "/shop/*/*": "allow"}


def test_empty_tables(spark, none):
    path = shared_folder(spark, "test")
    token_orc.write_tokens(none, path, tokenizer_file("byte_bpe_50k.json"), 2)
    assert token_orc.token_digest(token_orc.read_tokens(spark, path)).count() == 0
    settings = packing.Settings(tokenizer_file("word_bpe_49k.json"), 1, True)
    assert packing.pack(none, settings).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert pii.find(none).count() == 0
    assert quality.judge(none).count() == 0


def test_quality_judges_the_end_of_a_text(spark):
    """4,000 bytes of noise are seen wherever they stand, and so is a repetitive end."""
    rng = random.Random(5)
    signs = [chr(c) for c in range(33, 127)]
    noise = " ".join("".join(rng.choices(signs, k=9)) for _ in range(400))
    prose = LONG[:4150]
    docs = spark.createDataFrame(
        [(1, noise + prose), (2, prose + noise), (3, prose + LONG[:900]), (4, prose + " again" * 650)],
        "doc_id long, text string",
    )
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert found[1].chunk_high > 0.8 and found[2].chunk_high > 0.8
    assert found[4].chunk_low < 0.25
    assert {i for i, r in found.items() if r.kept} == {3}


def contaminated_pairs(spark, items, docs):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    return {(r.doc_id, r.item_id): r.reworded for r in found.collect()}


def test_decontamination_finds_copies_in_another_setting(spark):
    """What stands before an item, capitals and line ends don't hide a copy of it."""
    short, long = "Who wrote the novel Moby Dick?", "Which of the rivers Elbe and Main flows past Dresden?"
    docs = [
        (1, f"Question: {short} Answer"), (2, f"so {short}"), (3, f"one, {short}"), (4, short.upper()),
        (5, short.lower()), (6, short.replace(" Moby", "\nMoby")), (7, "Quiz: Who wrote the novel Jane Eyre?"),
        (8, "Question: Who wrote the play Moby Dick?"), (11, f"Question: {long}"), (12, long.upper()),
        (13, long.lower()), (14, long.replace(" Elbe", "\nElbe")),
    ]
    wanted = {(n, 1): n == 7 for n in range(1, 8)} | {(n, 2): False for n in range(11, 15)}
    assert contaminated_pairs(spark, [(1, short), (2, long)], docs) == wanted


def test_decontamination_finds_edited_and_slot_rich_items(spark):
    words = PASSAGE.split(" ")[:38]
    item = " ".join(words)
    sums, names = "Compute 12 + 5 * 3 - 7 + 9 now please", " and ".join(f"{c}anna Marie Berg" for c in "HJLSR")

    def edited(*places):
        return " ".join("changed" if k in places else w for k, w in enumerate(words))

    docs = [
        (1, f"see {edited(12, 25)} end"), (2, edited(7, 15, 23)), (3, edited(9, 19, 29)),
        (4, " ".join(words[:12])), (5, " ".join(words[:12] + ["other"] * 26)),
        (6, f"Task: {sums}"), (7, "Compute 1 + 2 * 3 - 4 + 5 now please"), (8, f"Present: {names}"),
        (9, f"Present: {names.replace('Lanna', 'Otto').replace('Ranna', 'Emil')}"),
        (10, " ".join(words[:14] + ["one", "more"] + words[14:26] + words[27:])),
    ]
    found = contaminated_pairs(spark, [(1, item), (2, sums), (3, names)], docs)
    assert set(found) == {(1, 1), (2, 1), (3, 1), (6, 2), (8, 3), (9, 3), (10, 1)}


def test_url_branches_with_a_small_share_of_a_large_host(spark):
    """A branch with 0.4 % of its host's pages keeps its own purity, beside many siblings."""
    ids = spark.range(100000)
    # 249 branches of about 400 pages, one of 398; its labelled pages are all blocked.
    letters = "concat('b', translate(cast(id % 250 as string), '0123456789', 'abcdefghij'))"
    pages = ids.selectExpr("id as page_id", f"concat('http://s.com/', {letters}, '/', "
                           "if(id div 250 < 300, 'x', 'y'), id) as url").where("id > 500 or id % 250 != 7")  # fmt: skip
    rules = [url_filter.Rule("block", "s.com", "/bh/x"),
             *[url_filter.Rule("allow", "s.com", f"/b{c}/x") for c in "abcdefg"]]
    found = url_filter.judge(pages, rules).where("rule is null").groupBy("template", "verdict").count()
    verdicts = {r.template: r.verdict for r in found.collect()}
    assert verdicts.pop("/bh/y#") == "block" and set(verdicts.values()) == {"allow"}
    assert "/bbe/y#" in verdicts and len(verdicts) >= 249
