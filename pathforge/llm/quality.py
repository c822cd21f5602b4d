"""Quality rules by compression bands.

A text is compressed by zstandard as a whole and in fixed chunks of ``CHUNK_BYTES``.  Its
ratio (compressed over plain bytes) must lie between the limits of its length band: less
means repetition, more means noise that does not compress.  Short texts carry zstandard's
fixed cost, so the limits widen as length falls, and below ``LEAST_BYTES`` there is no
verdict by compression.  A text also falls if more than ``BAD_CHUNK_SHARE`` of its chunks lie
outside ``CHUNK_LIMITS``; what is left behind the last whole chunk is judged in a chunk that
ends with the text, and a text shorter than a chunk by its band alone.

Null or empty text: no words, ``base_failed``, not kept.  Rows are judged one by one, so
ties, repeated rows and empty tables need no care, and other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, batchwise, chunks, mix64, windows, words_of

LEVEL = 3
CHUNK_BYTES = 4096
LEAST_BYTES = 128
#: floor(log2(bytes)): least and greatest ratio of the whole text; the last band is open.  Fitted to the
#: labelled documents of sf0.1 that pass the base rule.  From 4 KiB on good and poor ratios part, and the
#: least lies between them; below they overlap, and it lies under the least good one (at 10 lower still:
#: random words count as text).  The greatest is the greatest good ratio and 0.08; 7 has no such documents.
BANDS = {7: (0.42, 1.05), 8: (0.53, 0.81), 9: (0.50, 0.77), 10: (0.40, 0.66), 11: (0.445, 0.61), 12: (0.425, 0.56), 13: (0.404, 0.54), 14: (0.388, 0.51), 15: (0.375, 0.50)}
CHUNK_LIMITS = (0.415, 0.56)  # poor chunks 0.396 to 0.427, good ones 0.448 to 0.482
BAD_CHUNK_SHARE = 0.25
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def band(n_bytes: int) -> tuple[float, float] | None:
    """The limits for a text of so many bytes; None: no verdict."""
    return BANDS[min(int(math.log2(n_bytes)), max(BANDS))] if n_bytes >= LEAST_BYTES else None


def compression(raw: bytes, press) -> tuple[float | None, int, int, bool]:
    """Ratio of the whole, chunks, chunks outside the limits, and the verdict."""
    limits = band(len(raw))
    if limits is None:
        return None, 0, 0, True
    ratio = len(press(raw)) / len(raw)
    starts = chunk_starts(len(raw))
    bad = 0
    for i in starts:
        r = len(press(raw[i : i + CHUNK_BYTES])) / CHUNK_BYTES
        bad += not CHUNK_LIMITS[0] <= r <= CHUNK_LIMITS[1]
    return ratio, len(starts), bad, limits[0] <= ratio <= limits[1] and bad <= BAD_CHUNK_SHARE * len(starts)


def chunk_starts(n_bytes: int) -> list[int]:
    """Where the chunks of a text of so many bytes begin; together they cover it whole."""
    starts = [*range(0, n_bytes - CHUNK_BYTES + 1, CHUNK_BYTES)]
    if starts and n_bytes % CHUNK_BYTES:
        starts.append(n_bytes - CHUNK_BYTES)
    return starts


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def repeated_words(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text, the words in three-word windows that occur twice or more in it."""
    first, value = windows(hashes, at, 3)
    n_texts = len(at) - 1
    if not len(first):
        return np.zeros(n_texts, np.int64)
    text = np.searchsorted(at, first, "right") - 1
    key = mix64(value ^ mix64(text.astype(U) + U(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(first), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes) + 3, bool)
    for i in range(3):
        covered[first[twice] + i] = True
    total = np.concatenate([[0], np.cumsum(covered[: len(hashes)])])
    return total[at[1:]] - total[at[:-1]]


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    cols: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
    lines, ratios, ns, bads, fine = [], [], [], [], []
    for _, _, data, offsets in chunks(batch.column(1)):
        w = words_of(data, offsets)
        inside = np.zeros(len(data) + 1, np.int64)

        def per_text(mask, inside=inside, offsets=offsets):
            np.cumsum(mask, out=inside[1:])
            return inside[offsets[1:]] - inside[offsets[:-1]]

        cols["n_words"].append(w.counts())
        space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        cols["word_chars"].append(per_text(~space & ((data & 0xC0) != 0x80)))
        cols["n_symbols"].append(per_text(_SYMBOL[data]))
        cols["n_repeat_words"].append(repeated_words(w.hashes(), w.at))
        plain = data.tobytes()
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            raw = plain[lo:hi]
            lines.append(duplicate_lines(raw))
            r, n, bad, ok = compression(raw, press)
            ratios.append(r), ns.append(n), bads.append(bad), fine.append(ok)
    got = {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in cols.items()}
    failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
    kept = ~failed & np.array(fine, bool)
    i64 = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), i64(got["n_words"]), i64(got["word_chars"]), i64(got["n_symbols"]), i64(lines), i64(got["n_repeat_words"]),
         pa.array(failed), pa.array(kept), pa.array(ratios, pa.float64()), i64(ns), i64(bads)],
        names=[f.split()[0] for f in SCHEMA.split(", ")],
    )


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the base counts, the compression figures and ``kept``."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lambda batches: batchwise(_measure, batches), SCHEMA)


def _keep(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
    column = batch.column(at)
    verdict = _measure(pa.RecordBatch.from_arrays([pa.nulls(len(column), pa.int64()), column], names=["doc_id", "text"])).column(7)
    return batch.filter(verdict)


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; no shuffle."""
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda batches: batchwise(lambda b: _keep(b, at), batches), docs.schema)
