import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.llm.contamination import Leaks, block_keys, distance, find_leaks, first_meeting, keep_clean, simhash


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def brute(docs, items):
    """The best similarity over every window of the item's size."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            if not v or not w or d is None:
                continue
            k, n = min(5, len(v)), min(len(v), len(w))
            a = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            best = 0
            for s in range(len(w) - n + 1):
                b = Counter(tuple(w[j : j + k]) for j in range(s, s + n - k + 1))
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.8:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def corpus(seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeé", k=r.randint(2, 6))) for _ in range(500)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(8, 60))).capitalize()) for i in range(25)] + [(90, None), (91, " "), (92, "three little words"), (93, "x y " * 12), (None, "no id")]
    docs = [(0, None), (1, ""), (2, " \n "), (3, "one"), (4, "Three  LITTLE\nwords here"), (5, "x y " * 300)]
    for d in range(6, 90):
        w = r.choices(vocab, k=r.randint(5, 300))
        for _ in range(r.randint(0, 2)):
            v = items[r.randrange(25)][1].split()
            for _ in range(r.randint(0, 3)):
                j = r.randrange(len(v))
                v[j : j + r.randint(0, 1)] = r.choice([[], [r.choice(vocab)]])
            at = r.randint(0, len(w))
            w[at:at] = v
        docs.append((d, " ".join(w)))
    docs += [(200, items[3][1][: len(items[3][1]) * 9 // 10]), (None, items[4][1]), (201, items[4][1]), (201, items[5][1])]
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in find_leaks(d, b).collect()}
    want = {k: round(v, 9) for k, v in brute(docs, items).items()}
    assert len(want) > 40 and got == want
    left = {r.doc_id for r in keep_clean(d, b).collect()}
    assert left == {x for x, _ in docs} - {k for k, _ in got}
    assert find_leaks(d, b, Leaks(broadcast_rows=0)).count() == len(got)
    assert find_leaks(d.limit(0), b).count() == 0 and find_leaks(d, b.limit(0)).count() == 0
    assert keep_clean(d, b.limit(0)).count() == len(docs)


def test_best_window_between_alignments(spark):
    items, docs = [], []
    for i, (n, ends, put) in enumerate([(104, 3, 6), (58, 1, 2)] * 6):
        v = [f"w{i}x{j}" for j in range(n)]
        w = [f"e{i}x{j}" if j < ends or j >= n - ends else x for j, x in enumerate(v)]
        w[n // 2 : n // 2] = [f"p{i}x{j}" for j in range(put)]
        items.append((i, " ".join(v)))
        docs.append((i, " ".join([f"a{i}x{j}" for j in range(20)] + w + [f"b{i}x{j}" for j in range(20)])))
    half = [f"s{j}" for j in range(100)]  # halves that change places: the window lies on no alignment
    items.append((50, " ".join(half)))
    docs.append((50, " ".join(half[50:] + half[:50])))
    docs.append((51, " ".join([f"t{j}" for j in range(9)] + half[50:] + half[:50] + [f"u{j}" for j in range(200)])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in find_leaks(d, b).collect()}
    want = {k: round(v, 9) for k, v in brute(docs, items).items()}
    assert len(want) == 14 and got == want


def test_a_window_before_the_first_alignment(spark):
    item = [f"w{j}" for j in range(94)]
    text = ["a", "b"] + item[2:46] + ["p", "q", "r", "s"] + item[46:90] + ["y"] * 30
    d = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    want = brute([(1, " ".join(text))], [(7, " ".join(item))])
    assert len(want) == 1 and [(r.doc_id, r.item_id, round(r.similarity, 9)) for r in find_leaks(d, b).collect()] == [(1, 7, round(want[1, 7], 9))]


def test_long_texts_repeated_rows_and_common_passages(spark):
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdefgh", k=5)) for _ in range(4000)]
    items = [(i, " ".join(r.choices(vocab, k=50))) for i in range(30)]
    docs = [(0, " ".join(r.choices(vocab, k=20_000) + items[3][1].split() + r.choices(vocab, k=20_000)))]
    docs += [(i, " ".join(r.choices(vocab, k=30) + items[5][1].split())) for i in range(1, 60)] + [(1, items[6][1])] * 2
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(0, 3), (1, 6)} | {(i, 5) for i in range(1, 60)}
    for p in (Leaks(), Leaks(broadcast_rows=0, salts=3)):
        got = [(x.doc_id, x.item_id) for x in find_leaks(d, b, p).collect()]
        assert len(got) == len(want) and set(got) == want


def prints(spark, pairs):
    cut = lambda x: tuple(y - (1 << 64) if y >> 63 else y for y in (x & (1 << 64) - 1, x >> 64))
    rows = [(i, cut(a), cut(b)) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "i int, a struct<f0:long,f1:long>, b struct<f0:long,f1:long>")


def met(df, p):
    """(pair, block, bits): the keys at which the two sides meet."""
    a = df.select("i", "a", F.explode(block_keys("a", p.window_probe)).alias("k")).select("i", "a", "k.*")
    b = df.select("i", "b", F.explode(block_keys("b", p.item_probe)).alias("k")).select("i", "b", "k.*")
    return a.join(b, ["i", "block", "bits"])


def test_blocks_lose_no_fingerprint_within_the_radius(spark):
    r, p = random.Random(2), Leaks()
    pairs = []
    for k in range(300):
        a = b = r.getrandbits(128)
        for bit in r.sample(range(128), k % (p.radius + 1)):
            b ^= 1 << bit
        pairs.append((a, b))
    df = prints(spark, pairs)
    rows = met(df, p).where(distance("a", "b") <= p.radius).where(F.struct("block", "bits").eqNullSafe(first_meeting("a", "b", p)))
    assert sorted(x.i for x in rows.collect()) == list(range(300))  # each pair once
    with pytest.raises(ValueError):
        Leaks(radius=32)


def test_few_unrelated_fingerprints_meet(spark):
    r, p = random.Random(3), Leaks()
    df = prints(spark, [(r.getrandbits(128), r.getrandbits(128)) for _ in range(2000)])
    assert met(df, p).select("i").distinct().count() < 0.11 * 2000


def test_simhash_is_a_majority(spark):
    r = random.Random(3)
    hs = [r.getrandbits(64) - (1 << 63) for _ in range(31)]
    want = sum(1 << b for b in range(64) if sum((h >> b) & 1 for h in hs) * 2 > len(hs))
    got = spark.createDataFrame([(hs,)], "h array<long>").select(simhash(F.col("h"))).first()[0]
    assert got % (1 << 64) == want
