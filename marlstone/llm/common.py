"""What the training-data operators share: words, the shared folder, written tables and spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.tables import shared_folder, written

__all__ = ["shared_folder", "written"]

#: A word: anything but ASCII white space. ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows, and bytes on average, of the slices in which Python works through an Arrow batch.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows and bytes, so that a worker's memory doesn't follow the
    session's batch size, which stays as it is. One very long row is a slice of its own."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most // max(batch.nbytes, 1)))
        for start in range(0, max(batch.num_rows, 1), step):
            yield batch.slice(start, step)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the cluster sets to suit its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


#: Odd multipliers and shifts of the 64-bit finaliser (fixed values).
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing of each element."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def window_hashes(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    factor, out = np.uint64(base | 1), np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out *= factor
        out += hashes[k : k + n]
    return mixed(out)


def covered(n_words: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Marks the words that lie in a window of ``size`` words from any of ``starts``."""
    edges = np.zeros(n_words + size + 1, dtype=np.int32)
    edges[starts] += 1
    np.add.at(edges, starts + size, -1)
    return np.cumsum(edges[:n_words]) > 0


def joined_spans(spans: list[tuple[int, int, int, str]]) -> str:
    """``kind:start:end`` of (start, rank of kind, end, kind), by start, then rank, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, whatever else the table carries."""
    return df.select(*(F.col(f"`{c}`") for c in columns))
