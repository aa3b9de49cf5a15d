"""Each stage against a brute-force version over its own input."""

import zlib

import numpy as np
import pytest
import zstandard
from test_contamination import brute as leaks_of
from test_minhash import brute as components_of
from test_packing import Tokenizer, default_tokenizer
from test_pii import spans_of, trained

import corpus_pipeline
from marlstone.llm.pii import Decoder, masked
from marlstone.llm.quality import Bands, measure

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((docs, stage(spark, docs, SF)))
        path = str(tmp_path_factory.mktemp(name) / "t")
        out[-1][1].write.parquet(path)
        docs = spark.read.parquet(path)
        out[-1] = (out[-1][0], docs)
    return [tuple(x.toPandas() for x in s) for s in out]


def test_filters_equal_brute_force(spark, steps):
    packer = zstandard.ZstdCompressor(level=3)
    before, after = steps[0]
    assert set(after.doc_id) == {d for d, t in zip(before.doc_id, before.text) if measure(t, Bands(), packer)[6]}
    before, after = steps[1]
    parts = components_of(list(zip(before.doc_id, before.text)), 5, False)
    assert set(after.doc_id) == {d for d, (_, c) in parts.items() if d == c} and len(after) < len(before)
    before, after = steps[2]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    leaked = {d for d, _ in leaks_of(list(zip(before.doc_id, before.text)), [(i.item_id, i.text) for i in items])}
    assert set(after.doc_id) == set(before.doc_id) - leaked
    for _, after in steps[:4]:
        assert list(after.columns) == COLUMNS


def test_masking_and_packing(steps):
    before, after = steps[3]
    assert len(before) == len(after)
    new = dict(zip(after.doc_id, zip(after.text, after.n_chars)))
    for d, t in zip(before.doc_id, before.text):
        want = masked(t, sum(spans_of([t], Decoder(trained()))[0], []))
        assert new[d] == (want, len(want))
    before, after = steps[4]
    slow = Tokenizer.from_file(default_tokenizer())
    total = 0
    for d, t in zip(before.doc_id, before.text):
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        mine = after[after.doc_id == d].sort_values("piece")
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
        assert mine.length.sum() == len(ids)
        total += len(ids)
    assert after.sequence_id.nunique() <= -(-total // 1024) + 1


def test_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (None, "word " * 30, None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()
