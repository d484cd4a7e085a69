"""Quality rules: compression bands.

The zstandard ratio (compressed bytes over raw bytes) of a whole document and of parts of it tells
repetitive text (low) and incompressible text (high) from prose. What is normal depends on the length:
the lower limit has length classes (``LOWEST``), the upper one runs between measured lengths (``HIGHEST``),
above prose and below base64. A document is rejected when its whole ratio is outside its limits, or when
more than ``BAD_SHARE`` of its bytes are in repetitive chunks or incompressible pieces. Chunks and pieces
are equal parts of the text, so none has a rest that is not judged; below 256 bytes a document is one piece.

The base rules count words, symbols, repeated lines and repeated 8-word windows, exactly: windows are
compared by ranks of doubled runs (1, 2, 4, then 8 words), so no hash can collide and the cost is
n log n for a document of any length.

Cases: a null text has no words, fails the base rules and is not kept; so does an empty one. Equal texts
are judged alike. A very long text is split into chunks, never cut. An empty table gives no rows; columns
of the input named like the results are replaced.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from eventfold.llm.common import BLANKS, add_columns, table

LEVEL = 3
CHUNK_BYTES = 4096
#: Incompressible pieces are a quarter of the text, between these.
PIECE_BYTES = (128, 1024)
#: (least bytes, lowest ratio) of a whole document, and the lowest of a chunk. Short texts carry the format's
#: overhead and little history, long ones repeat their vocabulary.
LOWEST = ((0, 0.55), (64, 0.45), (100, 0.35), (200, 0.30), (1000, 0.25), (4000, 0.22), (32000, 0.18))
LOWEST_CHUNK = 0.22
#: (bytes, highest ratio) of a document or piece, in between by the logarithm. Prose of sf0.1 is below 0.75, 0.70,
#: 0.60, 0.53 and 0.49 from 256, 512, 1024, 2048 and 4096 bytes on, base64 at 0.94, 0.85, 0.80, 0.77 and 0.76. From
#: 96, 128 and 160 bytes on, 99.9 % of prose is below 1.02, 0.92 and 0.85, base64 above 1.02, 0.97 and 0.94. Fewer than
#: 90 bytes the format stores as they are, prose and noise alike, so only the lower limit tells anything there.
HIGHEST = ((90, 1.25), (100, 1.03), (128, 0.96), (160, 0.93), (200, 0.91), (256, 0.89), (512, 0.79), (1024, 0.72), (2048, 0.68), (4096, 0.65), (32768, 0.62))
BAD_SHARE = 0.2
LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8

_DROP_NOT_WORD = BLANKS.encode() + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
RESULTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, whole_ratio double, bad_chunk_share double, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of 8 that the text holds twice or more."""
    if len(words) <= WINDOW:
        return 0
    ranks: dict[bytes, int] = {}
    run = np.fromiter((ranks.setdefault(w, len(ranks)) for w in words), "i8", len(words))
    if len(ranks) == len(words):
        return 0
    width = 1
    while width < WINDOW:
        pairs = run[:-width] * (int(run.max()) + 1) + run[width:]
        run, width = np.unique(pairs, return_inverse=True)[1].astype("i8"), 2 * width
    again = np.bincount(run)[run] > 1
    edges = np.zeros(len(words) + 1, "i8")
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words), len(raw.translate(None, _DROP_NOT_WORD)), len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words),
    )


@lru_cache(1 << 16)
def highest(size: int) -> float:
    """The highest ratio of so many bytes of prose."""
    return float(np.interp(math.log2(max(size, 1)), [math.log2(n) for n, _ in HIGHEST], [r for _, r in HIGHEST]))


def parts(text: bytes, size: int) -> list[bytes]:
    """The text in equal parts of at least ``size`` bytes; a shorter text is one part."""
    n = max(1, len(text) // size)
    return [text[k * len(text) // n : (k + 1) * len(text) // n] for k in range(n)]


def ratios(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """The whole text's ratio, and the share of its bytes in repetitive chunks or incompressible pieces."""
    if not text:
        return 0.0, 0.0
    ratio = lambda part: len(packer.compress(part)) / len(part)
    least, most = PIECE_BYTES
    size, bad = min(most, max(least, len(text) // 4)), 0
    for chunk in parts(text, CHUNK_BYTES):
        bad += len(chunk) * (ratio(chunk) < LOWEST_CHUNK)
    for piece in parts(text, size):
        bad += len(piece) * (ratio(piece) > highest(len(piece)))
    return ratio(text), min(1.0, bad / len(text))


def within_bands(size: int, whole: float, bad_share: float) -> bool:
    low = next(a for least, a in reversed(LOWEST) if size >= least)
    return low <= whole <= highest(size) and bad_share <= BAD_SHARE


def judge(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    """The results for one text, in the order of ``RESULTS``."""
    n_words, chars, symbols, lines, repeated = base_counts(text or "")
    failed = n_words < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n_words
    raw = (text or "").encode()
    whole, bad = ratios(raw, packer)
    return n_words, chars, symbols, lines, repeated, failed, whole, bad, not failed and within_bands(len(raw), whole, bad)


def quality(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the results added."""
    df = df.drop(*(c.split()[0] for c in RESULTS.split(", ")))

    def start():
        packer = zstandard.ZstdCompressor(level=LEVEL)
        return lambda texts: (judge(t, packer) for t in texts)

    return add_columns(df, [text], RESULTS, start)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, ratios and the verdict for every document."""
    return quality(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
