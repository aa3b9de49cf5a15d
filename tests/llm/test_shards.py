import random
import zlib

import pytest

from marlstone.llm import shards
from marlstone.llm.shards import cuts, shard


def best(weights, parts):
    """Smallest feasible capacity by trying every sum of neighbours."""
    def need(c):
        n, used = 1, 0
        for w in weights:
            if w > c:
                return 1 << 60
            n, used = (n + 1, w) if used + w > c else (n, used + w)
        return n

    low, high = 0, sum(weights)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if need(mid) <= parts else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed,n,hot", [(1, 3000, 1), (2, 500, 40), (3, 10, 5), (4, 2000, 20000)])
def test_capacity_is_minimal(spark, monkeypatch, seed, n, hot):
    monkeypatch.setattr(shards, "FIRST_BITS", 3)
    monkeypatch.setattr(shards, "NEXT_BITS", 2)
    r = random.Random(seed)
    groups = sorted({r.getrandbits(shards.KEY_BITS): r.randint(8, 4000) for _ in range(n)}.items())
    groups[n // 3] = (groups[n // 3][0], 4000 * hot)
    df = spark.createDataFrame(groups, "key long, weight long")
    firsts, capacity = cuts(df, 7)
    assert capacity == best([w for _, w in groups], 7) and len(firsts) < 7
    loads = {}
    for k, w in groups:
        s = sum(f <= k for f in firsts)
        loads[s] = loads.get(s, 0) + w
    assert max(loads.values()) <= capacity


def test_rows(spark):
    r = random.Random(4)
    texts = [None, "", "é🙂"] + ["".join(r.choices("abcé ", k=r.randint(0, 400))) for _ in range(600)] + ["hot text"] * 300
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(5, "again", "c"), (None, "x", "c")], "doc_id long, text string, shard string")
    got = shard(df, 24).collect()
    assert len(got) == len(texts) + 2
    slots, by_text, loads = {}, {}, {}
    for g in got:
        slots.setdefault(g.shard, []).append(g.slot)
        loads[g.shard] = loads.get(g.shard, 0) + g.size
        if g.doc_id is not None and g.doc_id != 5:
            raw = (texts[g.doc_id] or "").encode()
            assert (g.size, g.text_crc32, g.law, g.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
            assert by_text.setdefault(raw, g.shard) == g.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and 0 <= min(slots) and max(slots) <= 23
    assert max(loads.values()) <= got[0].capacity
    assert shard(df.limit(0)).count() == 0


def test_long_texts_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "é" * 2_000_000), (1, "a"), (1, "b"), (None, None), (None, None), (2, "a")], "doc_id long, text string")
    got = shard(df, 3).collect()
    assert sorted(g.size for g in got) == [8, 8, 9, 9, 9, 4_000_008] and {g.capacity for g in got} == {4_000_008}
    assert len({(g.shard, g.slot) for g in got}) == 6 and dict(shard(df, 3).dtypes)["slot"] == "bigint"
