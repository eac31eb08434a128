"""Quality rules: counts of words, symbols and repeats, and bands of compression ratios.

Repetitive text compresses too well, and random text hardly at all. Each text is compressed
with zstandard whole and in fixed chunks; the ratio (compressed bytes to bytes) of the whole
must lie in the band for its length, since short texts compress less, and that of every
chunk in the chunk band, so that a bad stretch of a long text is seen too. Where the length is
no multiple of a chunk's, one more chunk ends with the text and overlaps the one before.

Null texts count as empty: no words, all counts 0, base_failed. Columns besides doc_id and text
are not used; repeated rows give repeated results. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.tables import WORD, whole_text

_WORD = re.compile(WORD)
# Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits on ratios: (bytes up to which the band holds, lowest, highest)."""

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 2.5),
        (256, 0.36, 1.20),
        (512, 0.40, 0.95),
        (1024, 0.38, 0.85),
        (2048, 0.36, 0.80),
        (8192, 0.33, 0.75),
        (65536, 0.30, 0.75),
        (float("inf"), 0.25, 0.75),
    )
    chunk: tuple[float, float] = (0.25, 0.80)
    chunk_bytes: int = 4096
    level: int = 3

    def of(self, size: int) -> tuple[float, float]:
        return next((low, high) for most, low, high in self.whole if size <= most)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, ratio double, chunk_low double, chunk_high double,"
    " base_failed boolean, kept boolean"
)


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    wordy = [line for line in lines if line.strip(" \t\n\x0b\x0c\r")]
    return len(wordy) - len(set(wordy))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    count, covered = 0, -1
    for at, window in enumerate(windows):
        if times[window] > 1:
            first = max(at, covered + 1)
            covered = at + 2
            count += covered - first + 1
    return count


def ratios(raw: bytes, compress, chunk_bytes: int) -> tuple[float, float, float]:
    """Ratio of the whole, and lowest and highest ratio of its chunks (of the whole, if it is
    shorter than one)."""
    if not raw:
        return 1.0, 1.0, 1.0
    whole = len(compress(raw)) / len(raw)
    stops = list(range(0, len(raw) - chunk_bytes + 1, chunk_bytes))
    if stops and len(raw) % chunk_bytes:
        stops.append(len(raw) - chunk_bytes)
    chunks = [len(compress(raw[at : at + chunk_bytes])) / chunk_bytes for at in stops]
    return whole, min(chunks, default=whole), max(chunks, default=whole)


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Counts, ratios and verdict for every document."""

    def measure(batches):
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        names = [part.split()[0] for part in SCHEMA.split(",")]
        for batch in batches:
            columns = [[] for _ in names]
            for doc_id, scalar in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = scalar.as_py()
                words = _WORD.findall(text)
                raw = text.encode()
                whole, low, high = ratios(raw, compress, bands.chunk_bytes)
                repeats = repeated_words(words)
                failed = len(words) < 50 or 100 * repeats > 50 * len(words)
                least, most = bands.of(len(raw))
                chunked = len(raw) >= bands.chunk_bytes
                good = least <= whole <= most and not (
                    chunked and (low < bands.chunk[0] or high > bands.chunk[1])
                )
                row = (
                    doc_id, len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)),
                    repeated_lines(text), repeats, whole, low, high, failed, good and not failed,
                )
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.bool_()] * 2
            yield pa.record_batch(
                [pa.array(x, type=kind) for x, kind in zip(columns, kinds)], names=names
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(measure, SCHEMA)
