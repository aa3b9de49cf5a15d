"""Quality rules: compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import covered, only, sliced, window_hashes
from marlstone.sources.tables import spread, table

SYMBOLS = b"#*$%&|<>"
SYMBOL_CHARS = tuple(bytes([c]) for c in SYMBOLS)
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits of zstandard ratios (compressed by raw bytes), inclusive, by length in bytes.

    ``whole``: (least length, least ratio, greatest ratio); the last row whose length is reached
    holds, and shorter texts than the first row's pass. ``chunk``: the limits of a full chunk of
    ``chunk_bytes``; what is left at the text's end is a chunk too, with the ``whole`` limits of its
    length. A document fails if over ``chunk_share`` of its chunks lie outside.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.40, 1.10),
        (512, 0.33, 0.90),
        (2048, 0.30, 0.80),
        (16384, 0.25, 0.75),
        (131072, 0.20, 0.75),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.25, 0.75)
    chunk_share: float = 0.5
    level: int = 3

    def limits(self, length: int) -> tuple[float, float]:
        """The ``whole`` limits of a length."""
        return next(((a, b) for least, a, b in reversed(self.whole) if length >= least), (0.0, float("inf")))

    def verdict(self, raw: bytes, packer) -> tuple[float | None, float, bool]:
        """The whole ratio (None: empty), the share of chunks outside, and whether the text passes."""
        if not raw:
            return None, 0.0, True
        ratio, size = len(packer.compress(raw)) / len(raw), self.chunk_bytes
        low, high = self.limits(len(raw))
        if len(raw) < size:  # its one chunk is the text
            passes = low <= ratio <= high
            return ratio, float(not passes), passes
        outside = 0
        for i in range(0, len(raw), size):
            part = raw[i : i + size]
            least, most = self.chunk if len(part) == size else self.limits(len(part))
            outside += not least <= len(packer.compress(part)) / len(part) <= most
        share = outside / -(-len(raw) // size)
        return ratio, share, low <= ratio <= high and share <= self.chunk_share


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words inside ``size``-word windows that the text has twice or more."""
    if len(words) <= size:
        return 0
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    windows = window_hashes(hashes, size, 0x9E3779B97F4A7C15)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    return int(covered(len(words), np.flatnonzero(np.isin(windows, twice)), size).sum())


def measure(text: str | None, bands: Bands, packer) -> tuple:
    """The base figures of a text, then the method's figures and both verdicts."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(raw.count, SYMBOL_CHARS))
    n_repeat = repeated_words(words)
    failed = n < 20 or 100 * n_repeat > 30 * n
    ratio, share, passes = bands.verdict(raw, packer)
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat, failed, not failed and passes, ratio, share


_FIGURES = (
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
    ("zstd_ratio", pa.float64()),
    ("outside_share", pa.float64()),
)
_SQL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, zstd_ratio double, outside_share double"
)


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: doc_id, the base figures, the two verdicts and the ratios behind them.

    Row-local: no shuffle; each text is read whole. A null text counts as empty; empty and very
    short texts fail the base rule and have no ratio or pass the bands. Repeated rows and null ids
    are judged each for itself; an empty table gives no rows; other columns are ignored.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in sliced(batches):
            rows = [measure(t.as_py(), bands, packer) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * len(_FIGURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, _FIGURES, strict=True))],
                ["doc_id", *(n for n, _ in _FIGURES)],
            )

    return only(docs, "doc_id", "text").mapInArrow(judge, f"doc_id {_id_type(docs)}, {_SQL}")


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that pass the rules, with all their columns. Cases as in ``quality_rules``."""
    at = docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in sliced(batches):
            keep = [measure(t.as_py(), bands, packer)[6] for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all of ``documents``."""
    return quality_rules(spread(table(spark, sf_dir, "documents")))


#: DuckDB SQL of the base figures (all columns but the compression verdict).
BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS g FROM w, unnest(range(1, len(words) - 6)) AS u(i)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2
), marked AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS o(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(marked.n, 0)::BIGINT AS n_repeat_words,
       len(words) < 20 OR 100 * coalesce(marked.n, 0) > 30 * len(words) AS base_failed
FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN marked USING (doc_id)
"""
