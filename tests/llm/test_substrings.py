import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.llm import substrings
from marlstone.llm.substrings import Cover, cut_repeats


def brute(rows, size=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i, w in words.items():
        for p in range(len(w) - size + 1):
            g = tuple(w[p : p + size])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone |= set(range(p, p + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeé", k=4)) for _ in range(150)]
    passages = [r.choices(vocab, k=k) for k in (12, 13, 14, 20, 60, 15)]
    texts = [None, "", "short text", " ".join(["x"] * 40), " ".join(["x"] * 30)]
    for _ in range(60):
        w = r.choices(vocab, k=r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)
        texts.append(" \n".join(w))
    texts += [texts[-1]] * 3
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, anchor string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in cut_repeats(df).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    t = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (9, t)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in cut_repeats(df).collect())
    assert got == [(-1, 0), (4, 0), (4, 0), (9, 20)]
    assert cut_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Cover(places=(0, 1))


def test_long_texts_many_cells_and_int_ids(spark, monkeypatch):
    r = random.Random(6)
    vocab = ["".join(r.choices("abcdef", k=5)) for _ in range(900)]
    long = r.choices(vocab, k=60_000)
    rows = [(0, " ".join(long)), (1, " ".join(r.choices(vocab, k=500) + long[30_000:30_040] + r.choices(vocab, k=500))), (2, " ".join(long[100:50_000]))]
    rows += [(i, " ".join(r.choices(vocab, k=100) + long[i : i + 15])) for i in range(3, 40)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    want = brute(rows)
    found = lambda: {g.doc_id: (g.n_words, g.n_removed, g.kept_sha256) for g in cut_repeats(df).collect()}
    assert found() == want
    monkeypatch.setattr(substrings, "CELL_BYTES", 20_000)  # more cells than tasks
    assert found() == want


def test_every_cell_has_its_own_task(spark):
    blobs = spark.range(8).selectExpr("cast(id as int) AS cell", "false AS known")
    per = substrings._dealt(blobs).groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert len(per) == 8 and {p["count"] for p in per} == {1}
