"""Best-fit packing of token pieces, improved by swap-based local search."""

from __future__ import annotations

import bisect
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import only, sliced, written
from marlstone.sources.tables import spread, table

#: Pieces that one task packs at a time, on average.
GROUP = 20_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The runs into which the byte-level splitter cuts a text (fixed values), over the characters up to
#: U+024F, where what is a letter, a number or a blank is settled.
_LETTER = "".join(chr(c) for c in range(0x250) if chr(c).isalpha())
_NUMBER = "0-9²³¹¼½¾"
_BLANK = "\\x09-\\x0d\\x20\x85\xa0"
_RUNS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|\x20?[{_LETTER}]+|\x20?[{_NUMBER}]+|\x20?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_SETTLED = re.compile("[^\x00-ɏ]")
#: Runs whose ids a worker remembers; then it starts anew.
KNOWN_RUNS = 400_000


class _Runs(dict):
    """The ids of each run, as little-endian 32-bit bytes; a new one is asked for."""

    def __init__(self, ids_of) -> None:
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, run: str) -> bytes:
        if len(self) > KNOWN_RUNS:
            self.clear()
        self[run] = found = self.ids_of(run).tobytes()
        return found


@lru_cache(maxsize=2)
def encoder(tokenizer: str):
    """text -> array of ids by ``tokenizers``, without special tokens added.

    Merges never cross the runs that the splitter cuts, so the model is asked for each run's ids once,
    in the splitter's signs for its bytes, and they are remembered. Texts with characters beyond U+024F or with a special token's string go to the
    tokenizer whole; so does every text of a vocabulary that isn't a plain byte-level one.
    """
    import json
    from pathlib import Path

    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer)
    special = [t.content for t in tool.get_added_tokens_decoder().values()]
    about = json.loads(Path(tokenizer).read_text(encoding="utf-8"))
    splitter = about.get("pre_tokenizer") or {}
    plain = about.get("normalizer") is None and splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)

    def whole(text: str) -> np.ndarray:
        return np.array(tool.encode(text, add_special_tokens=False).ids, dtype="<u4")

    signs = {c: "".join(run for run, _ in tool.pre_tokenizer.pre_tokenize_str(chr(c))) for c in range(0x250)} if plain else {}
    known = _Runs(lambda run: np.array([t.id for t in tool.model.tokenize(run.translate(signs))], dtype="<u4"))

    def encode(text: str) -> np.ndarray:
        if not plain or _SETTLED.search(text) or any(s in text for s in special):
            return whole(text)
        return np.frombuffer(b"".join(map(known.__getitem__, _RUNS.findall(text))), dtype="<u4")

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. Null texts count as empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array([end_id], dtype="<u4"))
                first = (len(ids) - 1) % capacity + 1
                starts = [0, *range(first, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(docs, "doc_id", "text").mapInArrow(cut, _PIECE)


def best_fit(sizes: list[int], capacity: int, order: list[int] | None = None) -> list[list[int]]:
    """Bins of indices: each size, largest first or by ``order``, goes to the bin that it leaves fullest."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit f: some bin has f free
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]) if order is None else order:
        size = sizes[i]
        if fits := open_ >> size:
            free = size + (fits & -fits).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                open_ &= ~(1 << free)
        else:
            at, free = len(bins), capacity
            bins.append([])
        bins[at].append(i)
        if left := free - size:
            by_free[left].append(at)
            open_ |= 1 << left
    return bins


class _Index:
    """Which underfull bins hold a document, or two documents, of a size, by the bins' room."""

    def __init__(self, sizes: list[int], bins: list[list[int]], fill: list[int], capacity: int) -> None:
        self.sizes, self.bins, self.fill, self.capacity = sizes, bins, fill, capacity
        self.holders: dict[tuple, dict] = {}  # (how many, their size) -> {(room, bin): documents}
        self.rooms: dict[tuple, Counter] = {}
        self.masks: dict[tuple, int] = {}
        self.added: dict[int, tuple[int, list[tuple]]] = {}

    def add(self, k: int) -> None:
        room, found = self.capacity - self.fill[k], {(0, 0): ()}
        for i in self.bins[k]:
            found.setdefault((1, self.sizes[i]), (i,))
        for total, two in _pairs(self.sizes, self.bins[k]).items():
            found[2, total] = two
        for key, docs in found.items():
            self.holders.setdefault(key, {})[room, k] = docs
            self.rooms.setdefault(key, Counter())[room] += 1
            self.masks[key] = self.masks.get(key, 0) | 1 << room
        self.added[k] = (room, list(found))

    def remove(self, k: int) -> None:
        if k not in self.added:
            return
        room, keys = self.added.pop(k)
        for key in keys:
            del self.holders[key][room, k]
            self.rooms[key][room] -= 1
            if not self.rooms[key][room]:
                self.masks[key] &= ~(1 << room)

    def find(self, total: int, counts: tuple[int, ...]) -> tuple[int, int, tuple] | None:
        """(gain, bin, documents) to exchange for documents of size ``total``: the largest gain."""
        widest = self.masks.get((0, 0), 0).bit_length() - 1
        for gain in range(min(widest, total), 0, -1):
            for n in counts:
                key = (n, total - gain)
                if (n == 0) == (gain == total) and (fits := self.masks.get(key, 0) >> gain):
                    room = gain + (fits & -fits).bit_length() - 1
                    k = min(b for r, b in self.holders[key] if r == room)
                    return gain, k, self.holders[key][room, k]
        return None


def _pairs(sizes: list[int], members: list[int]) -> dict[int, tuple[int, int]]:
    """Two members for each sum of two sizes. Sizes that differ add up to the fill at least, so they
    are few: at most 44 in a bin of 1024, however many documents it holds."""
    of_size: dict[int, list[int]] = {}
    for i in members:
        of_size.setdefault(sizes[i], []).append(i)
    found: dict[int, tuple[int, int]] = {}
    listed = sorted(of_size)
    for x, a in enumerate(listed):
        if len(of_size[a]) > 1:
            found.setdefault(2 * a, (of_size[a][0], of_size[a][1]))
        for b in listed[:x]:
            found.setdefault(a + b, (of_size[a][0], of_size[b][0]))
    return found


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empties bins by steps that each raise the sum of squared fills.

    The emptiest underfull bin gives: it moves a document to a bin with room, or exchanges one for
    a smaller one, one for two smaller ones, or two for a smaller one, always towards a fuller bin
    and with the largest gain. A bin without such a step is left alone. It ends when the total
    can't fill fewer bins or a pass over all bins finds no step; the rising sum bounds the steps.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    least, steps, before = -(-sum(fill) // capacity), 0, -1
    while steps > before and sum(map(bool, bins)) > least:
        before, count = steps, sum(map(bool, bins))
        index = _Index(sizes, bins, fill, capacity)
        order = sorted((f, k) for k, f in enumerate(fill) if 0 < f < capacity)
        for _, k in order:
            index.add(k)
        heapq.heapify(order)
        while order and count > least:
            known, giver = heapq.heappop(order)
            if giver not in index.added or fill[giver] != known:
                continue  # it has changed since, or is done
            index.remove(giver)
            while bins[giver]:
                step = _best_step(sizes, bins[giver], index)
                if step is None:
                    break
                steps += 1
                gain, gives, taker, takes = step
                index.remove(taker)
                bins[giver] = [i for i in bins[giver] if i not in gives] + list(takes)
                bins[taker] = [i for i in bins[taker] if i not in takes] + list(gives)
                fill[giver] -= gain
                fill[taker] += gain
                if fill[taker] < capacity:
                    index.add(taker)
                    heapq.heappush(order, (fill[taker], taker))
            if not bins[giver]:
                count -= 1
    return [b for b in bins if b]


def _best_step(sizes: list[int], mine: list[int], index: _Index) -> tuple[int, tuple, int, tuple] | None:
    """(gain, given, taking bin, taken back); a move of the largest document that fits comes first."""
    mine = sorted(mine, key=lambda i: -sizes[i])
    best, tried = None, set()
    for i in mine:
        if sizes[i] not in tried and (found := index.find(sizes[i], (0,))):
            return found[0], (i,), found[1], found[2]
        tried.add(sizes[i])
    tried.clear()
    for i in mine:
        if sizes[i] not in tried and (found := index.find(sizes[i], (1, 2))) and (best is None or found[0] > best[0]):
            best = (found[0], (i,), found[1], found[2])
        tried.add(sizes[i])
    for total, two in _pairs(sizes, mine).items():
        if (found := index.find(total, (1,))) and (best is None or found[0] > best[0]):
            best = (found[0], two, found[1], found[2])
    return best


def by_halves(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins filled in turn: the largest left, then what fits best; where two more fit, first the one
    nearest to half the room. Better than best fit where all sizes lie close together."""
    left, bins = sorted((s, i) for i, s in enumerate(sizes)), []
    while left:
        size, i = left.pop()
        room, members = capacity - size, [i]
        while left and left[0][0] <= room:
            aim = room // 2 if len(members) == 1 and 2 * left[0][0] <= room else room
            size, i = left.pop(max(0, bisect.bisect_right(left, (aim, len(sizes))) - 1))
            members.append(i)
            room -= size
        bins.append(members)
    return bins


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search from two starts; the one with fewer bins."""
    found = best_fit(sizes, capacity)
    if len(found) > -(-sum(sizes) // capacity):
        starts = (found, by_halves(sizes, capacity))
        found = min((local_search(sizes, b, capacity) for b in starts), key=len)
    return found


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, group: int = GROUP) -> DataFrame:
    """One row per piece: its place (sequence_id, offset) in a sequence of at most ``capacity``.

    Pieces are dealt at random to groups of about ``group``; each is packed by itself, so memory is
    bounded and a group wastes a part of one sequence. Null and empty texts are one piece of the end
    id; very long texts are as many pieces as they fill; repeated rows are packed each; a null doc_id stays null; an empty table gives no rows; other
    columns are ignored. A document is cut only where it is longer than ``capacity``.
    """
    table = written(pieces(docs, tokenizer, capacity, end_id))
    groups = max(1, -(-table.count() // group))
    dealt = table.withColumn("deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        sizes, deal = pdf["length"].tolist(), int(pdf["deal"].iloc[0])
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        for k, members in enumerate(pack_sizes(sizes, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = (deal << 32) + k, at
                at += sizes[i]
        return pdf.drop(columns="deal").assign(sequence_id=sequence, offset=offset)

    return dealt.groupBy("deal").applyInPandas(place, f"{_PIECE}, sequence_id long, offset long")


def default_tokenizer() -> str:
    """The place of the public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 1024 tokens."""
    return pack(spread(table(spark, sf_dir, "documents")), default_tokenizer())
