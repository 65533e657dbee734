"""Statistics of a text from one byte histogram and one pass over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the statistics table, all counts over the whole text.
STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
    "n_stops", "n_marks", "n_bars", "n_distinct", "longest_word", "n_accents", "n_short_words", "n_chars", "n_loud_words",
)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACE = np.array([9, 10, 11, 12, 13, 32])


def repeated_words(words: list[bytes]) -> int:
    """Positions of words that lie in a three-word window which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    if len(codes) == n:
        return 0
    m = len(codes)
    pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * m + ids[2:]
    _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[back] > 1
    hit = np.zeros(n, bool)
    for shift in range(3):
        hit[shift : n - 2 + shift] |= again
    return int(hit.sum())


def text_stats(raw: bytes) -> list[int]:
    """The values of STATS for a text's UTF-8 bytes; words end at ASCII white space alone."""
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_chars = int(h.sum() - h[0x80:0xC0].sum())
    lengths = [len(w) for w in words]
    return [
        len(words),
        n_chars - int(h[_SPACE].sum()),
        int(h[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(h[65:91].sum()),
        int(h[48:58].sum()),
        int(h[[46, 44, 58, 59]].sum()),
        int(h[[33, 63]].sum()),
        int(h[124]),
        len(set(words)),
        max(lengths, default=0),
        int(h[0xC0:].sum()),
        sum(n < 4 for n in lengths),
        n_chars,
        raw.count(b"!!"),
    ]


def ratios(stats: np.ndarray) -> np.ndarray:
    """Model inputs from rows of STATS: sizes on a log scale and shares, all finite for empty texts."""
    s = dict(zip(STATS, stats.T.astype(np.float64)))
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack(
        [
            np.log1p(s["n_words"]),
            s["word_chars"] / words,
            s["n_symbols"] / words,
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words,
            s["n_upper"] / chars,
            s["n_digits"] / chars,
            s["n_stops"] / words,
            s["n_marks"] / words,
            s["n_bars"] / words,
            s["n_distinct"] / words,
            np.log1p(s["longest_word"]),
            s["n_accents"] / chars,
            s["n_short_words"] / words,
            s["n_lines"] / words,
            s["n_loud_words"] / words,
        ],
        1,
    )


def with_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the STATS of each row's text.  A null text counts as empty."""
    src = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_raw"))
    fields = [f for f in src.schema.fields if f.name != "_raw"]
    from pyspark.sql.types import LongType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = np.array([text_stats(x.as_py()) for x in b.column(b.schema.get_field_index("_raw"))], np.int64).reshape(-1, len(STATS))
                cols = [b.column(b.schema.get_field_index(k)) for k in keep] + [pa.array(c) for c in rows.T]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *STATS])

    return src.mapInArrow(run, StructType([*fields, *[StructField(k, LongType()) for k in STATS]]))


def stats_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in STATS], 1)
