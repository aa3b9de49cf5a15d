import random

import duckdb
import pyarrow as pa
import pytest

from marlstone.llm.quality import BASE_SQL, keep_good, quality_rules

_R = random.Random(7)
PROSE = " ".join("".join(_R.choices("etaoinshrdlucmfw", k=_R.randint(2, 9))) for _ in range(200))
TEXTS = [
    None, "", "   \n\t ", "one", PROSE, PROSE, "spam spam " * 400, "a\x0bb\x0cc d " * 30, "#*$%&|<> x\n" * 30,
    "line one here\nline one here\n\nother\n", "é" * 50000, " ".join(map(str, range(30000))), PROSE + "\n" + PROSE,
]


def table(spark, texts=TEXTS):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string")


def test_base_figures_equal_sql(spark):
    got = {r.doc_id: r for r in quality_rules(table(spark)).collect()}
    documents = pa.table({"doc_id": list(range(len(TEXTS))), "text": TEXTS})  # noqa: F841
    want = duckdb.sql(BASE_SQL).fetchall()
    assert len(got) == len(want) == len(TEXTS)
    for row in want:
        g = got[row[0]]
        assert (g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == row


def test_bands_reject_repetition_and_keep_prose(spark):
    got = {r.doc_id: r for r in quality_rules(table(spark)).collect()}
    assert got[4].kept and got[5].kept
    assert not got[6].kept and not got[0].kept and got[0].zstd_ratio is None
    assert not got[10].kept


def test_filter_keeps_columns(spark):
    out = keep_good(table(spark))
    assert out.columns == ["doc_id", "text", "kept"]
    assert {r.doc_id for r in out.collect()} >= {4, 5}
    assert quality_rules(table(spark, [])).count() == 0


@pytest.mark.parametrize("copies", [2, 5])
def test_repeated_rows_are_judged_each(spark, copies):
    assert quality_rules(table(spark, [PROSE] * copies)).filter("kept").count() == copies


def test_the_last_piece_is_judged_too():
    import random

    import zstandard

    from marlstone.llm.quality import Bands

    r, packer, bands = random.Random(3), zstandard.ZstdCompressor(level=3), Bands()
    prose = " ".join("".join(r.choices("etaoinshrdlucmfw", k=r.randint(2, 9))) for _ in range(3000)).encode()
    noise = r.randbytes(6000)
    assert bands.verdict(prose[:4096], packer)[1:] == (0.0, True)
    assert bands.verdict(prose[:4096] + noise[:4095], packer)[1] == 0.5  # the tail alone lies outside
    assert bands.verdict(prose[:4096] + noise[:100], packer)[1] == 0.0  # too short for limits
    assert bands.verdict(noise[:3000], packer)[1:] == (1.0, False)
    assert [bands.limits(n) for n in (127, 128, 16384, 10**9)] == [(0.0, float("inf")), (0.40, 1.10), (0.25, 0.75), (0.20, 0.75)]


def test_null_ids_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, PROSE), (None, None), (1, PROSE), (1, "short")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.kept) for r in quality_rules(df).collect()) == [(0, False), (0, True), (1, False), (1, True)]
