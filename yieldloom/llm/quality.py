"""Quality rules by compression bands.

zstandard ratios (compressed by raw bytes) of the whole text and of its chunks
(as few equal ones of at most ``CHUNK`` bytes as hold all of it) are held against a band that depends on the length: text below the band
repeats itself, text above it looks random. Every text is judged on its own,
so nothing is shuffled and memory follows one slice of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, claim, pieces

#: (bytes from, lowest ratio, highest ratio). Short texts carry the frame's overhead and little context, so their band is wide.
BANDS = [
    (0, 0.0, 9.0), (64, 0.45, 9.0), (128, 0.42, 1.1), (256, 0.40, 0.98), (512, 0.36, 0.88),
    (1024, 0.31, 0.80), (2048, 0.27, 0.74), (4096, 0.24, 0.70), (16384, 0.20, 0.66), (65536, 0.17, 0.64),
]
CHUNK = 4096
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_CUT = re.compile(b"[^ \t-\r]")


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    k = int(ids.max()) + 1
    if k >= 1 << 21:  # three ids no longer fit one 64-bit key
        pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] * k + ids[2:]
    else:
        key = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    eq = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= eq
    twice[:-1] |= eq
    hit = np.zeros(n, bool)
    at = order[twice]
    for d in range(3):
        hit[at + d] = True
    return int(hit.sum())


def measure(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    chars = len(raw.translate(None, _SPACE + _CONTINUATION))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if _CUT.search(x)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(ids)


def band(size: int, bands: list[tuple[int, float, float]]) -> tuple[float, float]:
    low, high = 0.0, 9.0
    for at, a, b in bands:
        if size >= at:
            low, high = a, b
    return low, high


def verdict(raw: bytes, z: zstandard.ZstdCompressor, bands: list[tuple[int, float, float]], chunk: int, share: float) -> tuple[float, float, float, str]:
    """Whole ratio, share of chunks below and above their bands, reason ('' if inside)."""
    if not raw:
        return 1.0, 0.0, 0.0, ""
    ratio = len(z.compress(raw)) / len(raw)
    low, high = band(len(raw), bands)
    below = above = n = 0
    cuts = -(-len(raw) // chunk)
    for i in range(cuts):
        part = raw[len(raw) * i // cuts : len(raw) * (i + 1) // cuts]
        r = ratio if len(part) == len(raw) else len(z.compress(part)) / len(part)
        a, b = band(len(part), bands)
        below, above, n = below + (r < a), above + (r > b), n + 1
    reason = "repetitive" if ratio < low or below / n >= share else "incompressible" if ratio > high or above / n >= share else ""
    return ratio, below / n, above / n, reason


def judge(raw: bytes, z: zstandard.ZstdCompressor, bands: list[tuple[int, float, float]], chunk: int, share: float) -> tuple:
    """The result columns of one text."""
    m = measure(raw)
    failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
    v = verdict(raw, z, bands, chunk, share)
    return (*m, failed, not failed and not v[3], *v)


def keep_good(docs: DataFrame, text_col: str = "text", bands: list[tuple[int, float, float]] | None = None, chunk: int = CHUNK, share: float = 0.5, level: int = 3) -> DataFrame:
    """The rows whose text ``quality_rules`` keeps, with all their columns; nothing is shuffled."""
    limits = bands or BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        z = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        for b in pieces(batches, text_col):
            yield b.filter(pa.array([judge(raw, z, limits, chunk, share)[6] for raw in as_bytes(b.column(text_col))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: list[tuple[int, float, float]] | None = None,
    chunk: int = CHUNK, share: float = 0.5, level: int = 3,
) -> DataFrame:
    """One row per input row with the base counts, base_failed, kept, zstd_ratio, chunks_below, chunks_above, reason.

    A text fails the base rules with fewer than 50 words or when more than half
    of its words lie in repeated 3-word windows. It is kept if it passes them,
    its whole ratio is inside the band of its length, and fewer than ``share``
    of its chunks lie below (or above) theirs. NULL and empty texts have no
    words and fail; repeated rows are judged alike; other columns are not read.
    """
    limits = bands or BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        z = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        for b in pieces(batches, "text"):
            rows = []
            for raw in as_bytes(b.column(1)):
                m = measure(raw)
                failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
                v = verdict(raw, z, limits, chunk, share)
                rows.append((*m, failed, not failed and not v[3], *v))
            cols = list(zip(*rows, strict=True))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=NAMES)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, chunks_below double, chunks_above double, reason string",
    )


NAMES = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept zstd_ratio chunks_below chunks_above reason".split()
