"""File names: what is accepted, how names are cleaned and how outputs are called."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# These names and folders are part of the stored data.
PDF_SUFFIX = ".pdf"
MERGED_SUFFIX = "_OCRed.pdf"
OUTLINED_SUFFIX = "_OCRed_with_bookmarks.pdf"
UPLOAD_ROOT = "uploads/"
OUTPUT_ROOT = "ocr_output/"


def is_pdf(name: Column) -> Column:
    """True for names ending in .pdf in any case; false, never null, for no name."""
    return F.coalesce(F.lower(name).endswith(PDF_SUFFIX), F.lit(False))


def base_name(name: Column) -> Column:
    """The name without its last extension; leading dots start no extension."""
    return F.regexp_replace(name, r"(?s)^((?:.*/)?\.*[^./][^/]*)\.[^./]*$", "$1")


def merged_name(name: Column) -> Column:
    return F.concat(base_name(name), F.lit(MERGED_SUFFIX))


def outlined_name(name: Column) -> Column:
    """Name of the final document. Always lower-case, so `.PDF` uploads resolve too."""
    return F.concat(base_name(name), F.lit(OUTLINED_SUFFIX))


def batch_name(name: Column, start_page: Column, end_page: Column) -> Column:
    return F.format_string("%s_pages_%d_to_%d.pdf", base_name(name), start_page, end_page)


def page_image_name(name: Column, page_no: Column) -> Column:
    return F.format_string("%s_page_%d.png", base_name(name), page_no)


def page_number(image_name: Column) -> Column:
    """Page number held in a page image's name, as a number: page 10 follows page 9."""
    return F.regexp_extract(image_name, r"_page_(\d+)\.[^.]*$", 1).try_cast("int")


def output_path(path: Column) -> Column:
    """The same path below the output root; only the leading folder is changed."""
    return F.regexp_replace(path, f"^{UPLOAD_ROOT}", OUTPUT_ROOT)


def parent_folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


@lru_cache(maxsize=1)
def _ascii_forms() -> tuple[str, str, dict[str, str]]:
    """Non-ASCII characters with an ASCII compatibility form, by Unicode's own rule."""
    source, target, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        form = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(form) == 1:
            source.append(char)
            target.append(form)
        elif form:
            longer[char] = form
    return "".join(source), "".join(target), longer


def ascii_fold(text: Column) -> Column:
    """Replace accented and compatibility characters with their ASCII form.

    Characters with no ASCII form stay as they are. ASCII-only text, the usual case, is
    passed through after one pattern test.
    """
    source, target, longer = _ascii_forms()
    longer_map = F.create_map(*[F.lit(part) for pair in longer.items() for part in pair])
    single = F.translate(text, source, target)
    # Removing them is one hash lookup per character; a class of so many is not.
    has_longer = F.translate(single, "".join(longer), "") != single
    expanded = F.array_join(
        F.transform(F.split(single, ""), lambda c: F.coalesce(longer_map[c], c)), ""
    )
    return (
        F.when(~text.rlike(r"[^\x00-\x7F]"), text)
        .when(has_longer, expanded)
        .otherwise(single)
    )


def safe_filename(name: Column) -> Column:
    """A name fit for storage: ASCII letters, digits, `_`, `.` and `-` only.

    Accents are folded, path separators and runs of white space become one `_`, all else
    is dropped, and dots and underscores at the ends are trimmed. May come out empty.
    """
    spaced = F.regexp_replace(ascii_fold(name), r"[/\s\x1c-\x1f]+", " ")
    joined = F.regexp_replace(F.trim(spaced), " ", "_")
    kept = F.regexp_replace(joined, r"[^A-Za-z0-9_.\-]", "")
    return F.regexp_replace(kept, r"^[._]+|[._]+$", "")
