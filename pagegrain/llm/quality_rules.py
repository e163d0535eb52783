"""Quality rules: word counts of each text, and bands of zstandard ratios.

Text that compresses far better than prose repeats itself, text that hardly
compresses is not prose; both are judged on the whole document and on fixed
chunks, with limits by length.  The limits come from ``sampled_limits`` over a
bounded sample of rows labelled good.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import bounded_batches, id_text, slices

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
CHUNK = 4096
#: Length classes of documents, each from so many bytes on.
CLASSES = (0, 512, 1024, 2048, 4096, 8192, 16384)
#: Share of the sample's good rows (of their chunks) that may lie under a limit; the upper limit is the greatest ratio plus SLACK.
#: With under FEW rows such a share tells nothing: the lower limit is then the least ratio less SLACK.
LOST, SLACK, FEW = 0.005, 0.02, 100
#: From so many bytes on: least and most of compressed / plain, for whole documents and for chunks; ``sampled_limits`` at
#: level 3 of the 3409 rows labelled quality 1 of documents at scale 0.1, of which 3243 pass the base rules.
BANDS = (
    (0, 0.549, 0.745), (512, 0.517, 0.702), (1024, 0.481, 0.6), (2048, 0.455, 0.541), (4096, 0.43, 0.492),
    (8192, 0.416, 0.471), (16384, 0.383, 0.448),
)
CHUNK_BAND = (0.445, 0.524)
#: Share of chunks outside their band from which on a document goes.
CHUNK_SHARE = 0.5


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = WORD.findall(text)
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    duplicate = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                duplicate += WORD.search(line) is not None
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        until = 0
        for i, window in enumerate(windows):
            if window in often:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return len(words), len("".join(words)), symbols, duplicate, repeated


def limits(n: int) -> tuple[float, float]:
    """The band for a document of ``n`` bytes."""
    return next((low, high) for least, low, high in reversed(BANDS) if n >= least)


def ratios(raw: bytes, compress) -> tuple[float, list[float]]:
    """compressed / plain of the whole and of each chunk; a last chunk under half joins the one before."""
    n = len(raw)
    starts = list(range(0, max(n - CHUNK // 2, 1), CHUNK))
    parts = [raw[a:b] for a, b in zip(starts, [*starts[1:], n])]
    whole = len(compress(raw)) / n
    return whole, [whole] if len(parts) == 1 else [len(compress(p)) / len(p) for p in parts]


def sampled_limits(texts, compress) -> tuple[tuple, tuple[float, float]]:
    """BANDS and CHUNK_BAND from good texts, by LOST, SLACK and FEW, to three places.

    Texts that fail the base rules are left out, as are classes without a text; chunks count where there are two or more.
    """
    wholes: dict[int, list[float]] = {}
    parts: list[float] = []
    for text in texts:
        if text and not verdict(text, compress)[5]:
            raw = text.encode()
            whole, chunks = ratios(raw, compress)
            wholes.setdefault(max(c for c in CLASSES if c <= len(raw)), []).append(whole)
            parts += chunks if len(chunks) > 1 else []

    def band(told: list[float]) -> tuple[float, float]:
        low = min(told) - SLACK if len(told) < FEW else float(np.quantile(told, LOST))
        return round(low, 3), round(max(told) + SLACK, 3)

    return tuple((least, *band(wholes[least])) for least in sorted(wholes)), band(parts) if parts else CHUNK_BAND


def verdict(text: str, compress) -> tuple:
    """The counts, base_failed, whole ratio, share of chunks outside their band, kept."""
    told = counts(text)
    failed = told[0] < 50 or 100 * told[4] > 50 * told[0]
    if not text:
        return *told, failed, None, None, False
    raw = text.encode()
    whole, chunks = ratios(raw, compress)
    low, high = limits(len(raw))
    outside = sum(not CHUNK_BAND[0] <= c <= CHUNK_BAND[1] for c in chunks) / len(chunks) if len(chunks) > 1 else 0.0
    return *told, failed, whole, outside, not failed and low <= whole <= high and outside < CHUNK_SHARE


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> DataFrame:
    """A row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, whole_ratio, chunk_outside (share), kept.

    base_failed: under 50 words, or over half of the words lie in 3-word
    windows that occur twice or more.  kept: not base_failed, and the ratios
    are in their bands.
    Null text is empty (and fails); ids may be null or repeat; an empty table
    gives no rows; other columns are ignored.
    """

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        for batch in slices(batches):
            rows = [verdict(text, packer.compress) for text in batch.column(1).to_pylist()]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, whole_ratio double, chunk_outside double, kept boolean"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    return id_text(df, id_col, text_col).mapInArrow(run, schema)


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; the verdict is a column of each row, so nothing is joined."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        return pd.Series([verdict(t, packer.compress)[-1] for t in texts.fillna("")], dtype=bool)

    return docs.filter(passes(F.col(f"`{text_col}`").cast("string")))
