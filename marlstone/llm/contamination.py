"""Benchmark decontamination: SimHash over item-sized windows, a multi-index of Hamming blocks, and
exact weighted-shingle similarity. All of it is DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import SPACE, written
from marlstone.sources.tables import spread, table

_BLANKS = " \t\n\x0b\x0c\r"
#: A fingerprint is two majority hashes of 64 bits, cut in blocks of 16 (fixed values).
BITS, BLOCK = 128, 16
BLOCKS = BITS // BLOCK


@dataclass(frozen=True)
class Leaks:
    """Parameters. At the threshold 0.8 fingerprints differ in about 19 bits of 128, and by chance in
    more than ``radius`` at about one window in a thousand.

    Two fingerprints within the radius differ in at most ``radius // BLOCKS`` bits of some block, so
    a key within ``window_probe`` bits of the one's block lies within ``item_probe`` of the other's.
    """

    words: int = 5
    numerator: int = 80
    denominator: int = 100
    radius: int = 31
    window_probe: int = 1
    item_probe: int = 2
    #: Shingles, and blocks' keys, of the benchmark up to which they are broadcast; more are joined by
    #: a shuffle, with each key of a block dealt to ``salts`` tasks.
    broadcast_rows: int = 400_000
    salts: int = 16

    def __post_init__(self) -> None:
        if BLOCKS * (self.window_probe + self.item_probe + 1) <= self.radius:
            raise ValueError("the probes don't reach the radius")


def _held(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with computed columns that later expressions can use many times, yet are evaluated once."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    names = F.explode(F.array(F.struct(*columns))).alias("__held")
    return df.select(*kept, names).select(*kept, "__held.*")


def words(text: str) -> Column:
    """Lower-cased words of a text column; a blank text has one empty word."""
    clean = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_BLANKS))
    return F.split(clean, SPACE)


def shingles(column: str, k: int) -> Column:
    """A hash of each run of ``k`` words of a held array column; none if there are fewer."""
    every = F.transform(F.col(column), lambda w, i: F.xxhash64(F.slice(F.col(column), i + 1, k)))
    return F.slice(every, 1, F.greatest(F.size(column) - (k - 1), F.lit(0)))


def simhash(hashes: Column) -> Column:
    """64 majority bits of the hashes, each as often as it occurs (2,097,151 hashes at most).

    Three bits at a time are counted in lanes of 21 bits of one sum.
    """
    spread, lanes, lane = 1 | 1 << 20 | 1 << 40, 1 | 1 << 21 | 1 << 42, (1 << 21) - 1
    zero = F.lit(0).cast("long")
    three = lambda h, j: F.call_function("shiftrightunsigned", h, j * 3).bitwiseAND(F.lit(7).cast("long"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(21)), lambda j: F.aggregate(hashes, zero, lambda s, h: s + (three(h, j) * spread).bitwiseAND(F.lit(lanes))))
    most = lambda s, k: 2 * F.shiftright(s, 21 * k).bitwiseAND(F.lit(lane)) > F.size(hashes)
    bits = F.transform(counts, lambda s: sum((F.when(most(s, k), 1 << k).otherwise(0) for k in (1, 2)), F.when(most(s, 0), 1).otherwise(0)).cast("long"))
    return F.aggregate(F.transform(bits, lambda x, j: F.call_function("shiftleft", x, j * 3)), zero, lambda a, x: a.bitwiseOR(x))


def fingerprint(hashes: Column) -> Column:
    """The majority bits of the hashes, and of hashes of them."""
    return F.struct(simhash(hashes).alias("f0"), simhash(F.transform(hashes, lambda h: F.xxhash64(h))).alias("f1"))


def _masks(most: int) -> list[int]:
    """All values of a block with up to ``most`` bits."""
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(BLOCK), k)]


def _block(print_: str, j: int) -> Column:
    """Block ``j`` of a fingerprint column."""
    per = BLOCKS // 2
    return F.shiftrightunsigned(F.col(f"{print_}.f{j // per}"), BLOCK * (j % per)).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int")


def block_keys(print_: str, most: int) -> Column:
    """(block, bits): all values within ``most`` bits of each block of a fingerprint column."""
    masks = F.array(*map(F.lit, _masks(most)))

    def keys(j: int) -> Column:
        own = _block(print_, j)
        return F.transform(masks, lambda m: F.struct(F.lit(j).alias("block"), own.bitwiseXOR(m).alias("bits")))

    return F.flatten(F.array(*map(keys, range(BLOCKS))))


def distance(a: str, b: str) -> Column:
    """Bits in which two fingerprint columns differ."""
    apart = lambda f: F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}")))
    return apart("f0") + apart("f1")


def first_meeting(a: str, b: str, p: Leaks) -> Column:
    """Of all keys (block, bits) at which two fingerprints meet, one, so that a pair is one row: in the
    first block that is close enough, with the lowest bits in which they differ turned."""

    def turned(j: int) -> Column:
        bits = _block(a, j)
        for _ in range(p.window_probe):
            apart = bits.bitwiseXOR(_block(b, j))
            bits = bits.bitwiseXOR(apart.bitwiseAND(-apart))
        return F.struct(F.lit(j).alias("block"), bits.alias("bits"))

    close = lambda j: F.bit_count(_block(a, j).bitwiseXOR(_block(b, j))) <= p.window_probe + p.item_probe
    return F.coalesce(*(F.when(close(j), turned(j)) for j in range(BLOCKS)))


def _fingerprinted(df: DataFrame) -> DataFrame:
    """Adds the fingerprint ``print`` and the bag of ``hashes``, in which a repeat counts by its number."""
    df = _held(df, F.array_sort("hashes").alias("sorted"))
    bag = F.transform("sorted", lambda x, i: F.xxhash64(x, i - F.array_position(F.col("sorted"), x)))
    return df.select(*(c for c in df.columns if c not in ("sorted", "hashes")), fingerprint(F.col("hashes")).alias("print"), bag.alias("bag"))


def _items(benchmark: DataFrame, k: int) -> DataFrame:
    """(item_id, n, w, unit): items with a word; ``unit`` is how many words a shingle of them takes."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", F.col("text"))
    items = _held(items, words("text").alias("w")).where(F.element_at("w", 1) != "")
    return items.select("item_id", F.size("w").alias("n"), "w", F.least(F.size("w"), F.lit(k)).alias("unit"))


def _candidates(docs: DataFrame, items: DataFrame, unit: int, p: Leaks) -> DataFrame:
    """Distinct (doc_id, n, start, size, unit): windows of an item's size that one of its shingles
    aligns with, and all between two such that one window can reach.

    A window before all alignments of the shingles it shares loses none of them by a step onward,
    one behind them all loses none by a step back. So the best lies on or between alignments.
    """
    own = items.where(F.col("unit") == unit)
    marks = _held(own, shingles("w", unit).alias("hashes")).select("n", F.posexplode("hashes").alias("at", "hash")).distinct()
    marks = written(marks)
    marks = F.broadcast(marks) if marks.count() <= p.broadcast_rows else marks
    seen = _held(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), words("text").alias("w"))
    seen = seen.select("doc_id", F.size("w").alias("length"), F.posexplode(shingles("w", unit)).alias("pos", "hash"))
    size = F.least("n", "length")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("length") - size))
    aligned = seen.join(marks, "hash").select("doc_id", "n", start.alias("start"), size.alias("size"))
    aligned = aligned.groupBy("doc_id", "n", "size").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    after = lambda i: F.get("starts", i + 1)
    reached = lambda a, i: after(i) - a <= 2 * (F.col("n") - unit)
    every = F.transform("starts", lambda a, i: F.when(reached(a, i), F.sequence(a, after(i) - 1)).otherwise(F.array(a)))
    return aligned.select("doc_id", "n", F.explode(F.flatten(every)).alias("start"), "size", F.lit(unit).alias("unit"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: Leaks = Leaks()) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, start, n_words,
    shared, united, similarity, of the most similar window (the first of equals among those looked at).

    A window of as many words as the item, or the whole of a shorter document, on or between the
    places where shared shingles align gets a SimHash fingerprint; keys near its blocks meet keys near
    the blocks of items of that size; pairs within the radius are held to ``shared / united`` of the
    weighted shingles (a shingle counts as often as it occurs), which must reach the threshold. Items
    under five words count as one shingle. Null or blank texts and items hold nothing; very long texts
    are searched whole; rows without an id can't be named and are left out; rows that repeat an id
    count together; empty tables give no rows; other columns are ignored.
    """
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    items = written(_items(benchmark, p.words))
    units = sorted(r.unit for r in items.select("unit").distinct().collect())  # at most ``words`` of them
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, n_words int, shared int, united int, similarity double")
    found = [_leaks(docs, items, unit, p) for unit in units]
    every = empty
    for f in found:
        every = every.union(f)
    best = F.max_by(F.struct("start", "n_words", "shared", "united", "similarity"), F.struct("similarity", -F.col("start")))
    return every.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def _leaks(docs: DataFrame, items: DataFrame, unit: int, p: Leaks) -> DataFrame:
    candidates = written(_candidates(docs, items, unit, p))
    asked = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("n", "start", "size")).alias("windows"))
    texts = _held(docs.join(asked, "doc_id"), words("text").alias("w")).select("doc_id", "w", F.explode("windows").alias("win"))
    texts = texts.where(F.col("win.start") + F.col("win.size") <= F.size("w"))  # of rows that share an id
    part = texts.select("doc_id", "win.*", F.slice("w", F.col("win.start") + 1, F.col("win.size")).alias("part"))
    windows = written(_fingerprinted(_held(part, shingles("part", unit).alias("hashes")).drop("part")))
    mine = _held(items.where(F.col("unit") == unit), shingles("w", unit).alias("hashes"))
    mine = written(_fingerprinted(mine.select("item_id", "n", "hashes")).withColumnRenamed("print", "item_print").withColumnRenamed("bag", "item_bag"))
    key = ["n", "block", "bits"]
    left = windows.select("doc_id", "n", "start", "size", "print", F.explode(block_keys("print", p.window_probe)).alias("k")).select("doc_id", "start", "size", "print", "n", "k.*")
    right = mine.select("item_id", "n", "item_print", F.explode(block_keys("item_print", p.item_probe)).alias("k")).select("item_id", "item_print", "n", "k.*")
    if mine.count() * BLOCKS * len(_masks(p.item_probe)) <= p.broadcast_rows:
        met = left.join(F.broadcast(right), key)
    else:  # many windows share a key where one passage is common
        salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
        met = left.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(p.salts)).cast("int")).join(salted, [*key, "salt"])
    once = F.struct("block", "bits").eqNullSafe(first_meeting("print", "item_print", p))
    pairs = met.where((distance("print", "item_print") <= p.radius) & once).select("doc_id", "n", "start", "size", "item_id")
    full = pairs.join(windows.drop("print"), ["doc_id", "n", "start", "size"]).join(mine.drop("n", "item_print"), "item_id")
    shared = F.size(F.array_intersect("bag", "item_bag"))
    full = _held(full, shared.alias("shared"), (F.size("bag") + F.size("item_bag")).alias("both"))
    full = full.withColumn("united", F.col("both") - F.col("shared")).where(F.col("shared") * p.denominator >= F.col("united") * p.numerator)
    return full.select("doc_id", "item_id", "start", F.col("size").alias("n_words"), "shared", "united", (F.col("shared") / F.col("united")).alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, p: Leaks = Leaks()) -> DataFrame:
    """The documents that hold no benchmark item, with all columns; rows without an id stay."""
    leaked = find_leaks(docs, benchmark, p).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all of ``benchmark`` held by all ``documents``."""
    return find_leaks(spread(table(spark, sf_dir, "documents")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB SQL of the whole result: windows of an item's size on or between alignments of shared shingles.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
j AS (SELECT item_id, len(w) AS n, least(len(w), 5) AS unit, w FROM i WHERE len(w) > 0),
a AS (SELECT item_id, n, unit, p AS q, array_to_string(w[p : p + unit - 1], ' ') AS g FROM j, unnest(range(1, n - unit + 2)) AS u(p)),
b AS (SELECT item_id, n, unit, g, count(*) AS c FROM a GROUP BY item_id, n, unit, g),
s AS (SELECT doc_id, len(w) AS length, unit, p, array_to_string(w[p : p + unit - 1], ' ') AS g FROM d, (SELECT DISTINCT unit FROM j), unnest(range(1, len(w) - unit + 2)) AS u(p)),
m AS (SELECT s.doc_id, item_id, s.unit, n, least(n, length) AS size, length, s.p, s.g, c FROM s JOIN b ON s.g = b.g AND s.unit = b.unit),
-- each shared shingle counts in the windows that hold it: starts p - (size - unit) to p
v AS (SELECT doc_id, item_id, unit, n, size, start, g, least(count(*), c) AS met FROM m,
      unnest(range(greatest(1, p - size + unit), least(p, length - size + 1) + 1)) AS o(start) GROUP BY doc_id, item_id, unit, n, size, start, g, c),
t AS (SELECT doc_id, item_id, start, size, sum(met)::INTEGER AS shared, (n - unit + 1 + size - unit + 1 - sum(met))::INTEGER AS united, n FROM v GROUP BY doc_id, item_id, start, size, n, unit),
l AS (SELECT DISTINCT doc_id, n, greatest(1, least(p - q + 1, length - least(n, length) + 1)) AS x, s.unit FROM s JOIN a ON s.g = a.g AND s.unit = a.unit),
o AS (SELECT doc_id, n, x, lead(x) OVER (PARTITION BY doc_id, n ORDER BY x) - x AS gap, unit FROM l),
k AS (SELECT doc_id, n, unnest(range(x, x + CASE WHEN gap <= 2 * (n - unit) THEN gap ELSE 1 END)) AS start FROM o)
SELECT DISTINCT ON (doc_id, item_id) doc_id, item_id, (start - 1)::INTEGER AS start, size::INTEGER AS n_words, shared, united, shared / united AS similarity
FROM t SEMI JOIN k USING (doc_id, n, start) WHERE shared * 100 >= united * 80 ORDER BY doc_id, item_id, shared / united DESC, start"""
