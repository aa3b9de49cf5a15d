"""Substring deduplication: difference-cover anchors, extended to whole windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import covered, only, partitions, sliced, window_hashes
from marlstone.sources.tables import spread, table

_ANCHOR, _LOW, _HIGH = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


@dataclass(frozen=True)
class Cover:
    """Positions p with p mod ``period`` in ``places``: for any two offsets some shift below
    ``period`` takes both to such positions. So two equal runs of ``window`` words share a hash of
    ``window - period + 1`` words that starts at a cover position in both."""

    window: int = 13
    period: int = 7
    places: tuple[int, ...] = (1, 2, 4)

    def __post_init__(self) -> None:
        differences = {(a - b) % self.period for a in self.places for b in self.places}
        if differences != set(range(self.period)) or self.window <= self.period:
            raise ValueError("the places aren't a difference cover, or the window isn't longer than the period")

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1

    def anchors(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions of a text and the hashes of the words from there."""
        every = window_hashes(hashes, self.anchor, _ANCHOR)
        at = np.flatnonzero(np.isin(np.arange(len(every)) % self.period, self.places))
        return at, every[at]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _lanes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    import xxhash

    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


#: Anchors or windows that a task gathers before it deals them to cells.
BUFFER = 1_000_000
#: Bytes of an anchor's hash that travel, as a chance match only makes a window be looked at in full,
#: and of a window's: among the 1e13 windows of 100 TB two different ones share 12 bytes with a chance
#: of 1e-3.
ANCHOR_BYTES, WINDOW_BYTES = 5, 12
_ANCHOR_MASK = np.uint64((1 << 8 * ANCHOR_BYTES) - 1)
#: Bytes of text whose anchors or windows make a cell, all of which a task holds at a time.
CELL_BYTES = 32 << 20
_BLOB = "cell int, known boolean, docs binary, counts binary, values binary, starts binary"
_BLOB_KINDS = (pa.int32(), pa.bool_(), *[pa.binary()] * 4)


def _packed(low: np.ndarray, high: np.ndarray, size: int) -> bytes:
    """``size`` bytes of each hash of 64 and 32 bits, the low ones first."""
    raw = np.empty((len(low), 12), dtype=np.uint8)
    raw[:, :8], raw[:, 8:] = low.astype("<u8").view(np.uint8).reshape(-1, 8), high.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(raw[:, :size]).tobytes()


def _unpacked(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(raw) // size, 12), dtype=np.uint8)
    out[:, :size] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, size)
    return np.ascontiguousarray(out[:, :8]).view("<u8").ravel(), np.ascontiguousarray(out[:, 8:]).view("<u4").ravel()


def _grouped(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where sorted hashes differ from the one before."""
    return np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])


class _Dealer:
    """Gathers (hash, document, start) and yields them as blobs by cell of the hash, or of the
    document for what is ``known`` already: of equal hashes only the smallest id travels on; the
    others meet it here, so a hot passage costs each task one row a cell."""

    def __init__(self, cells: int, size: int, with_starts: bool) -> None:
        self.cells, self.size, self.with_starts = cells, size, with_starts
        self.clear()

    def clear(self) -> None:
        self.held, self.count = [], 0

    def add(self, doc: int, low: np.ndarray, high: np.ndarray | None = None, starts: np.ndarray | None = None) -> None:
        self.held.append((doc, low, high, starts))
        self.count += len(low)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        low = np.concatenate([x[1] for x in self.held])
        docs = np.repeat(np.array([x[0] for x in self.held], dtype=np.int64), [len(x[1]) for x in self.held])
        high = np.concatenate([x[2] for x in self.held]) if self.with_starts else np.zeros(len(low), dtype=np.uint32)
        starts = np.concatenate([x[3] for x in self.held]).astype(np.int64) if self.with_starts else np.zeros(len(low), dtype=np.int64)
        self.clear()
        order = np.lexsort((starts, docs, high, low))
        low, high, docs, starts = low[order], high[order], docs[order], starts[order]
        new = _grouped(low, high)
        group = np.cumsum(new) - 1
        least = docs[np.flatnonzero(new)][group]
        if self.with_starts:  # later documents' windows go; the first one's travel on
            known, sent = docs > least, docs == least
        else:  # anchors that two documents have are shared; one of them travels on
            known = (docs[np.flatnonzero(np.append(new[1:], True))] != docs[np.flatnonzero(new)])[group]
            sent = new
        top = (low >> np.uint64(12)).astype(np.int64) & 0x7FFFFFFF
        yield from self.blobs(True, docs[known] % self.cells, docs[known], low[known], high[known], starts[known])
        yield from self.blobs(False, top[sent] % self.cells, docs[sent], low[sent], high[sent], starts[sent])

    def blobs(self, known, cell, docs, low, high, starts) -> Iterator[pa.RecordBatch]:
        if not len(docs):
            return
        order = np.lexsort((docs, cell))
        cell, docs, low, high, starts = cell[order], docs[order], low[order], high[order], starts[order]
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        rows = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            ids, counts = np.unique(docs[a:b], return_counts=True)
            values = b"" if known and self.with_starts else _packed(low[a:b], high[a:b], self.size)
            where = starts[a:b].astype("<i4").tobytes() if self.with_starts else b""
            rows.append((int(cell[a]), known, ids.astype("<i8").tobytes(), counts.astype("<i4").tobytes(), values, where))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _BLOB_KINDS, strict=True)], _BLOB.replace(",", "").split()[::2])


def _dealt(blobs: DataFrame) -> DataFrame:
    """Blobs by cell: one cell to a task, or neighbours in turn where there are more cells than tasks
    (sorted by Spark, which spills), so that Python holds one cell whatever the number of tasks."""
    parts = partitions(blobs.sparkSession)
    return blobs.repartitionById(parts, F.col("cell") % parts).sortWithinPartitions("cell")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows (docs repeated, values, starts) of each cell, one cell after the other."""
    now, held = None, []
    for batch in batches:
        for cell, _, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if cell != now and held:
                yield held
                held = []
            now = cell
            held.append((np.repeat(np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[1], "<i4")), raw[2], raw[3]))
    if held:
        yield held


def _met(blobs: DataFrame, cells: int, size: int, with_starts: bool) -> DataFrame:
    """Blobs by cell of the document: the anchors that are shared, or the starts that go."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def fresh() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if (some := batch.filter(batch.column(1))).num_rows:
                    passed.append(some)
                yield batch.filter(pc.invert(batch.column(1)))

        for held in _by_cell(fresh()):
            yield from passed
            passed.clear()
            docs = np.concatenate([x[0] for x in held])
            low, high = _unpacked(b"".join(x[1] for x in held), size)
            starts = np.frombuffer(b"".join(x[2] for x in held), "<i4") if with_starts else np.zeros(len(docs), dtype=np.int64)
            held.clear()
            order = np.lexsort((docs, high, low))
            docs, low, high, starts = docs[order], low[order], high[order], starts[order]
            new = _grouped(low, high)
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            if with_starts:
                hit = docs > docs[first][group]
            else:
                hit = (docs[np.flatnonzero(np.append(new[1:], True))] != docs[first])[group]
            yield from _Dealer(cells, size, with_starts).blobs(True, docs[hit] % cells, docs[hit], low[hit], high[hit], starts[hit])
        yield from passed

    return _dealt(blobs).mapInArrow(meet, _BLOB)


def _gathered(blobs: DataFrame, size: int, with_starts: bool) -> DataFrame:
    """(doc_id, found): one row per document, its anchors or starts packed."""
    width = 4 if with_starts else size

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_cell(batches):
            docs = np.concatenate([x[0] for x in held])
            values = np.frombuffer(b"".join(x[2 if with_starts else 1] for x in held), dtype=np.uint8).reshape(-1, width)
            held.clear()
            order = np.argsort(docs, kind="stable")
            docs, values = docs[order], values[order]
            edges = [0, *(np.flatnonzero(docs[1:] != docs[:-1]) + 1).tolist(), len(docs)]
            cuts = list(zip(edges[:-1], edges[1:], strict=True))
            for k in range(0, len(cuts), 1024):
                some = cuts[k : k + 1024]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(docs[a]) for a, _ in some], pa.int64()), pa.array([values[a:b].tobytes() for a, b in some], pa.binary())], ["doc_id", "found"]
                )

    return _dealt(blobs).mapInArrow(gather, "doc_id long, found binary")


def repeated_starts(docs: DataFrame, cover: Cover = Cover()) -> DataFrame:
    """(doc_id, found): where windows start in a document that also start in one with a smaller id.

    ``found``: binaries of little-endian 32-bit starts. Only hashes at cover positions are dealt out;
    those that two documents have go back to their documents, where each is extended to the whole
    windows that hold it. Windows are held against the smallest id with the same 96-bit hash of their
    words. Tasks exchange packed blobs by cells of the hash; equal ones meet first in the task they
    come from, and groups are only reduced to their smallest id, never paired, so a common passage
    costs its occurrences. Cells follow from the bytes of text, so a task's memory doesn't grow.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    cells = max(partitions(docs.sparkSession), -(-size // CELL_BYTES))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(cells, ANCHOR_BYTES, False)
        for batch in sliced(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(text.as_py())
                if len(words) >= cover.window:
                    dealer.add(doc, np.unique(cover.anchors(_lanes(words)[0])[1] & _ANCHOR_MASK))
                if dealer.count >= BUFFER:
                    yield from dealer.flush()
        yield from dealer.flush()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(cells, WINDOW_BYTES, True)
        for batch in sliced(batches):
            for doc, text, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = _words(text.as_py())
                if len(words) < cover.window:  # of rows that share an id
                    continue
                low, high = _lanes(words)
                at, found = cover.anchors(low)
                hit = at[np.isin(found & _ANCHOR_MASK, _unpacked(shared.as_py(), ANCHOR_BYTES)[0])]
                # a window from p holds the anchors that start at p to p + period - 1
                starts = np.unique((hit[:, None] - np.arange(cover.period)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(words) - cover.window)]
                more = window_hashes(high, cover.window, _HIGH)[starts] >> np.uint64(32)
                dealer.add(doc, window_hashes(low, cover.window, _LOW)[starts], more.astype(np.uint32), starts)
                if dealer.count >= BUFFER:
                    yield from dealer.flush()
        yield from dealer.flush()

    shared = _gathered(_met(docs.mapInArrow(anchors, _BLOB), cells, ANCHOR_BYTES, False), ANCHOR_BYTES, False)
    near = docs.join(shared, "doc_id").select("doc_id", "text", "found")
    return _gathered(_met(near.mapInArrow(windows, _BLOB), cells, WINDOW_BYTES, True), WINDOW_BYTES, True)


def cut_repeats(docs: DataFrame, cover: Cover = Cover()) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by
    one space).

    A word goes if a window over it also starts in a document with a smaller id; windows are judged
    on the input. Null, empty and short texts lose nothing. Rows that repeat an id count as one
    document for "smaller"; each is cut at the starts found in any of them (equal rows alike). Null
    ids lose nothing; very long texts are read whole; an empty table gives no rows; other columns are
    ignored.
    """
    every = only(docs, "doc_id", "text")
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":
        every = every.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = every.where("doc_id IS NOT NULL")  # both joins then read one exchange of the texts
    starts = repeated_starts(docs, cover)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts, removed, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = _words(text.as_py())
                left = words
                if found.is_valid:
                    at = np.unique(np.frombuffer(found.as_py(), "<i4"))
                    gone = covered(len(words), at[at <= len(words) - cover.window], cover.window)
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    bare = every.where("doc_id IS NULL").withColumn("found", F.lit(None).cast("binary"))
    return docs.join(starts, "doc_id", "left").select("doc_id", "text", "found").union(bare).mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 13 words or more cut from all ``documents``."""
    return cut_repeats(spread(table(spark, sf_dir, "documents"))).drop("kept")


#: DuckDB SQL of the whole result.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM w, unnest(range(1, len(w) - 11)) AS u(i)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM f, unnest(range(0, 13)) AS o(k) WHERE first < doc_id),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w) AS x
      ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""
