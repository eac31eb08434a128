"""Row rules: required fields, allow-listed domains, options and status wording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The states a file goes through and the options a run accepts.
NOT_PROCESSED = "Not processed"
PROCESSING = "Processing"
PROCESSED = "Processed"
FAILED = "Failed"
BASIC = "basic"
ADVANCED = "advanced"

# Reasons given for what is refused.
NOT_A_PDF = "Invalid file type. Only PDFs are allowed."
NO_PROJECT = "Project not found"
NO_FILE = "File not found"
NO_IDS = "No project IDs provided"
INVALID_OPTION = "Invalid OCR option provided."

# What a reader is offered for a file in each state, and where links begin.
ACTIONS = {
    PROCESSED: "Download", NOT_PROCESSED: "Start OCR", PROCESSING: "Processing...",
    FAILED: "Show Error",
}
DOWNLOAD_LINK, ERROR_LINK = "/download/", "/error/"


def has_domain(email: Column, domains: Sequence[str]) -> Column:
    """True where the address ends with one of the allowed `@domain` suffixes."""
    found = F.lit(False)
    for domain in domains:
        found = found | F.coalesce(email.endswith(domain), F.lit(False))
    return found


def is_blank(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")), F.lit("")) == ""


def missing_fields(*names: str) -> Column:
    """Array with one message per required column that is null or blank."""
    messages = [F.when(is_blank(F.col(name)), F.lit(f"{name} is required")) for name in names]
    return F.array_compact(F.array(*messages))


def run_option(option: Column) -> Column:
    """Lower-cased run option, `basic` where none is given."""
    return F.coalesce(F.lower(option), F.lit(BASIC))


def is_valid_option(option: Column) -> Column:
    return run_option(option).isin(BASIC, ADVANCED)


def status_action(status: Column) -> Column:
    """What a reader can do next with a file in this state; empty for unknown states."""
    action = F.lit("")
    for state, label in ACTIONS.items():
        action = F.when(status == state, label).otherwise(action)
    return action


def download_url(status: Column, file_id: Column) -> Column:
    return F.when(status == PROCESSED, F.concat(F.lit(DOWNLOAD_LINK), file_id.cast("string")))


def error_url(status: Column, file_id: Column) -> Column:
    return F.when(status == FAILED, F.concat(F.lit(ERROR_LINK), file_id.cast("string")))


def key_uuid(*key: Column) -> Column:
    """A UUID-shaped id made from the key, so a re-run task writes the same value."""
    digest = F.md5(F.concat_ws("\u0001", *[k.cast("string") for k in key]))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
