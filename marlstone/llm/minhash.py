"""Near duplicates: circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import mixed, only, sliced, window_hashes, word_hashes, written
from marlstone.operators.components import connected_components
from marlstone.operators.tables import joined_back
from marlstone.sources.tables import spread, table

_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters. At the threshold 0.8, 28 bands of 4 miss a pair with a chance of 4e-7."""

    words: int = 5
    fold_case: bool = False
    numerator: int = 80
    denominator: int = 100
    bands: int = 28
    rows: int = 4
    #: Up to this many members, all pairs of a bucket are compared; larger ones go by leaders.
    small_bucket: int = 16
    #: Rounds of leaders before what is left of a large bucket is compared in full.
    rounds: int = 8
    #: Members of a block, where a bucket is compared in blocks.
    block: int = 64


def shingle_set(text: str | None, size: int, fold_case: bool = False) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; fewer words count as one shingle."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (raw.lower() if fold_case else raw).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return mixed(word_hashes([b" ".join(words)]))
    return np.unique(window_hashes(word_hashes(words), size, _BASE))


def _permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(shingles: np.ndarray, size: int, block: int = 1024) -> np.ndarray:
    """``size`` coordinates from two permutations of the 32-bit ring: the first scatters the
    shingles, the second is shifted by one place for each coordinate."""
    places = _permuted((shingles >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(places), block):
        np.minimum(out, _permuted(places[None, i : i + block] + shifts).min(axis=1), out=out)
    return out


def sketches(docs: DataFrame, p: NearDuplicates) -> DataFrame:
    """Per row: doc_id, n_shingles, a digest of the whole set, and the bands' hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in sliced(batches):
            counts, digests, bands = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), p.words, p.fold_case)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    signature = circulant_signature(s, p.bands * p.rows).reshape(p.bands, p.rows)
                    bands.append(
                        np.array([xxhash.xxh3_64_intdigest(b.tobytes(), seed=i) for i, b in enumerate(signature)], dtype=np.uint64).view(np.int64)
                    )
                else:
                    bands.append(np.empty(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return only(docs, "doc_id", "text").mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, p: NearDuplicates) -> DataFrame:
    """(a, b, shared, united) over full sets, of distinct pairs (a, b)."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").distinct().join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None  # rows come sorted by a: its set serves all its partners
        for batch in sliced(batches):
            shared, united = [], []
            for a, ta, tb in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if (a := a.as_py()) != last:
                    last, mine = a, shingle_set(ta.as_py(), p.words, p.fold_case)
                other = shingle_set(tb.as_py(), p.words, p.fold_case)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                shared.append(both)
                united.append(len(mine) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(united, pa.int64())], ["a", "b", "shared", "united"])

    return written(joined.mapInArrow(compare, "a long, b long, shared long, united long"))


def _linked(p: NearDuplicates):
    return F.col("shared") * p.denominator >= F.col("united") * p.numerator


def _near(p: NearDuplicates):
    """Jaccard distance is a metric: further than twice the threshold's distance from a leader,
    a member links to none of those that link to the leader."""
    return F.col("shared") * p.denominator >= F.col("united") * (2 * p.numerator - p.denominator)


def _within(members: DataFrame) -> DataFrame:
    """All pairs of each bucket; for buckets of bounded size only."""
    other = members.select("band", F.col("doc").alias("b"))
    return members.select("band", F.col("doc").alias("a")).join(other, "band").where("a < b").select("a", "b")


def _edges(checked: DataFrame, p: NearDuplicates) -> DataFrame:
    return checked.where(_linked(p)).select("a", "b")


def _own_share(docs: DataFrame, texts: DataFrame, p: NearDuplicates) -> DataFrame:
    """(doc, own): how many shingles of each no other of ``docs`` has."""
    chosen = only(texts.join(docs.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), "doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), p.words, p.fold_case).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), doc)), pa.array(s)], ["doc", "shingle"])

    each = chosen.mapInArrow(rows, "doc long, shingle long")
    each = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc").alias("doc"))
    own = each.where("n = 1").groupBy("doc").agg(F.count("*").alias("own"))
    return docs.select("doc").distinct().join(own, "doc", "left").select("doc", F.coalesce("own", F.lit(0)).alias("own"))


def links(members: DataFrame, texts: DataFrame, sizes: DataFrame, p: NearDuplicates) -> DataFrame:
    """Edges (a, b) that connect what the buckets' linked pairs connect.

    Small buckets: all pairs. Large ones: in rounds, all members are compared with a leader, the one
    with the smallest share of shingles of its own; those that link leave, the others go on among
    themselves. A member that is near its leader, but doesn't link, might link to one that left,
    unless too many of its shingles are in no other member: it is held against all of these, blocks
    against blocks. No cap drops a pair: what the rounds leave is compared in full, in blocks too.
    """
    sized = members.groupBy("band").agg(F.count("*").alias("n"))
    active = members.join(sized.where("n > 1"), "band")
    checked = _verified(_within(active.where(F.col("n") <= p.small_bucket)), texts, p)
    edges = _edges(checked, p)
    active = written(active.where(F.col("n") > p.small_bucket).select("band", "doc"))
    stars: DataFrame | None = None
    if not active.isEmpty():
        own = _own_share(active, texts, p).join(sizes.select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n")), "doc")
        own = written(own.select("doc", "n", "own", (F.col("own") / F.col("n")).alias("rare")))
        active = written(active.join(own.select("doc", "rare"), "doc"))
    for k in range(p.rounds + 1):
        if active.isEmpty():
            break
        if k == p.rounds:
            edges = edges.union(_block_links(active.select(F.col("band").alias("group"), "doc"), None, texts, p))
            break
        leaders = active.groupBy("band").agg(F.min(F.struct("rare", "doc")).alias("leader")).select("band", F.col("leader.doc").alias("a"))
        star = written(active.join(leaders, "band").where("doc <> a").select("band", "a", F.col("doc").alias("b"), "rare"))
        against = _verified(star, texts, p)
        star = written(star.join(against, ["a", "b"]))
        edges = edges.union(_edges(star, p))
        near = star.where(_near(p))
        stars = near if stars is None else stars.union(near)
        rest = star.where(~_linked(p)).select("band", F.col("b").alias("doc"), "rare")
        sized = rest.groupBy("band").agg(F.count("*").alias("n"))
        rest = rest.join(sized.where("n > 1"), "band")
        few = rest.where(F.col("n") <= p.small_bucket)
        edges = edges.union(_edges(_verified(_within(few), texts, p), p))
        active = written(rest.where(F.col("n") > p.small_bucket).select("band", "doc", "rare"))
    if stars is not None:
        # to link at all, a set may have so many shingles of its own at most
        open_ = stars.where(~_linked(p)).select(F.col("a").alias("group"), F.col("b").alias("doc")).distinct()
        open_ = open_.join(own, "doc").where((F.col("n") - F.col("own")) * p.denominator >= F.col("n") * p.numerator)
        held = stars.where(_linked(p)).select(F.col("a").alias("group"), F.col("b").alias("doc")).distinct()
        edges = edges.union(_block_links(open_.select("group", "doc"), held, texts, p))
    return edges.distinct()


def _blocked(members: DataFrame, texts: DataFrame, p: NearDuplicates) -> DataFrame:
    """(group, block, ids, texts) of members (group, doc), dealt to blocks of bounded expected size."""
    members = written(members)
    sized = written(members.groupBy("group").agg(F.ceil(F.count("*") / p.block).alias("blocks"), F.count("*").alias("n")))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    dealt = joined_back(members, sized, "group", "n", total).select("group", "doc", F.pmod(F.xxhash64("doc"), "blocks").alias("block"))
    dealt = dealt.join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")
    return dealt.groupBy("group", "block").agg(F.collect_list("doc").alias("ids"), F.collect_list("text").alias("texts"))


def _block_links(left: DataFrame, right: DataFrame | None, texts: DataFrame, p: NearDuplicates) -> DataFrame:
    """Links of each group's left members to its right ones, or among the left ones if there are no
    right ones: blocks meet blocks, and each meeting gives the links of a spanning forest only."""
    mine = written(_blocked(left, texts, p))
    other = mine if right is None else _blocked(right, texts, p)
    other = other.select("group", F.col("block").alias("block_2"), F.col("ids").alias("ids_2"), F.col("texts").alias("texts_2"))
    met = mine.join(other, "group").where(F.lit(right is not None) | (F.col("block") <= F.col("block_2")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts_, ids_2, texts_2 in zip(*(batch.column(k) for k in range(4)), strict=True):
                a, b = ids.as_py(), ids_2.as_py()
                sets = [shingle_set(t, p.words, p.fold_case) for t in texts_2.as_py()]
                sizes = np.array([len(s) for s in sets])
                all_ = np.concatenate(sets)
                starts = np.cumsum(sizes) - sizes
                root: dict[int, int] = {}

                def find(x: int, root: dict[int, int] = root) -> int:
                    while root.setdefault(x, x) != x:
                        x = root[x]
                    return x

                found = []
                for x, t in zip(a, texts_.as_py(), strict=True):
                    s = shingle_set(t, p.words, p.fold_case)
                    at = np.minimum(np.searchsorted(s, all_), len(s) - 1)
                    shared = np.add.reduceat(s[at] == all_, starts, dtype=np.int64)
                    for k in np.flatnonzero(shared * p.denominator >= (len(s) + sizes - shared) * p.numerator):
                        if find(x) != find(b[k]):
                            root[find(x)] = find(b[k])
                            found.append((x, b[k]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return written(met.select("ids", "texts", "ids_2", "texts_2").repartition("ids", "ids_2").mapInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets form a class by a grouped minimum; only the smallest id of a
    class is banded, so groups of copies cost a row each. ``component_id`` is the smallest id that
    links reach. Null, empty and blank texts have no shingles and link with nothing. A null id is a
    component of its own (null, kept); rows that repeat an id share its component; very long texts give
    all their shingles. An empty table
    gives no rows; other columns are ignored.
    """
    docs = only(docs, "doc_id", "text")
    sketch = written(sketches(docs, p))
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n_shingles")))
    banded = classes.select(F.col("rep").alias("doc"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = written(banded.join(shared, "band"))
    texts = written(docs.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    parts = connected_components(links(members, texts, classes.select("rep", "n_shingles"), p))
    named = classes.join(parts, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = full.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select("doc_id", "n_shingles", "component_id")
    least = out.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    repeated = least.where("n > 1")
    if not repeated.isEmpty():
        out = out.drop("component_id").join(least.drop("n"), "doc_id")
    bare = sketch.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The documents with one of each near-duplicate component (the smallest id), all columns.

    Of rows that repeat an id all stay; other cases as in ``near_duplicates``.
    """
    gone = near_duplicates(docs, p).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all ``documents`` over lower-cased two-word shingles."""
    return near_duplicates(spread(table(spark, sf_dir, "documents")), NearDuplicates(words=2, fold_case=True))


#: DuckDB SQL of the whole result: all pairs that share a shingle and are near in size, on full sets.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, hash(unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT s.doc_id, g, n, count(*) OVER (PARTITION BY g) AS df FROM s JOIN n USING (doc_id)),
-- a pair that links shares one of the rarest fifth of either set
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS k FROM r),
c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM p AS a JOIN p AS b ON a.g = b.g AND a.doc_id < b.doc_id
      WHERE 5 * (a.k - 1) <= a.n AND 5 * (b.k - 1) <= b.n AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT x, y FROM c JOIN r AS a ON a.doc_id = x JOIN r AS b ON b.doc_id = y AND a.g = b.g GROUP BY x, y, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
t(x, y) AS (SELECT DISTINCT x, x FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x),
m AS (SELECT x, min(y) AS component FROM t GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON x = w.doc_id"""
