import os
import re
import unicodedata

from pyspark.sql import functions as F

from folioflow.functions import names, rules


def public_rule(name):
    """The published rule for cleaning a file name."""
    text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode("ascii")
    text = text.replace("/", " ")
    return re.sub(r"[^A-Za-z0-9_.-]", "", "_".join(text.split())).strip("._")


def values(spark, texts, make):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = frame.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in got]


def test_safe_filename_follows_the_rule_for_every_character(spark):
    codes = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "b".join(map(chr, codes[i:i + 40])) + "z" for i in range(0, len(codes), 40)]
    assert values(spark, texts, names.safe_filename) == [public_rule(t) for t in texts]


def test_safe_filename_edges(spark):
    texts = ["My cool movie.mov", "../../../etc/passwd", "i contain \xfcml\xe4uts.txt", "", "...",
             "_x_", " a  b ", "\x1fa\x1cb", "Stra\xdfe.PDF", "été.pdf", "ﬁle 10½™.pdf"]
    assert values(spark, texts, names.safe_filename) == [public_rule(t) for t in texts]


def test_base_name_matches_the_library_split(spark):
    texts = ["a.pdf", "a.b.pdf", ".pdf", "..pdf", "a..pdf", "noext", "dir.x/file", "d/.hid", "x.", ""]
    assert values(spark, texts, names.base_name) == [os.path.splitext(t)[0] for t in texts]


def test_output_names_are_lower_case(spark):
    assert values(spark, ["a.b.PDF"], names.merged_name) == ["a.b_OCRed.pdf"]
    assert values(spark, ["a.PDF"], names.outlined_name) == ["a_OCRed_with_bookmarks.pdf"]
    batch = lambda n: names.batch_name(n, F.lit(11), F.lit(20))
    assert values(spark, ["r.pdf"], batch) == ["r_pages_11_to_20.pdf"]


def test_pdf_check_and_paths(spark):
    assert values(spark, ["a.pdf", "a.PDF", "a.pdf.txt", None], names.is_pdf) == [True, True, False, False]
    paths = ["uploads/1/uploads/uploads.pdf", "other/uploads/a.pdf"]
    assert values(spark, paths, names.output_path) == [
        "ocr_output/1/uploads/uploads.pdf", "other/uploads/a.pdf"]
    assert values(spark, ["uploads/1/a.pdf"], names.parent_folder) == ["uploads/1"]


def test_page_numbers_are_numbers(spark):
    images = ["x_page_9.png", "x_page_10.png", "x_page_2_page_3.png", "x.png"]
    assert values(spark, images, names.page_number) == [9, 10, 3, None]


def test_rules(spark):
    assert values(spark, ["Basic", "ADVANCED", None, "fast"], rules.run_option) == [
        "basic", "advanced", "basic", "fast"]
    assert values(spark, ["Basic", None, "fast"], rules.is_valid_option) == [True, True, False]
    assert values(spark, ["Processed", "Not processed", "Processing", "Failed", "?", None],
                  rules.status_action) == [
        "Download", "Start OCR", "Processing...", "Show Error", "", ""]
    domains = lambda e: rules.has_domain(e, ["@a.example", "@b.example"])
    assert values(spark, ["x@a.example", "x@b.example", "x@a.example.org", None], domains) == [
        True, True, False, False]
    urls = values(spark, ["Processed", "Failed"], lambda s: rules.download_url(s, F.lit(7)))
    assert urls == ["/download/7", None]


def test_key_uuid_is_stable_and_shaped(spark):
    ids = values(spark, ["a", "a", "b"], rules.key_uuid)
    assert ids[0] == ids[1] != ids[2]
    assert re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", ids[0])
