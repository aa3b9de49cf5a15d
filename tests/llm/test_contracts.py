"""Columns and types that each registered query must return, in this order, over whole tables."""

import pytest

from marlstone.llm import registry

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_secret_scan": ("documents", "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"),
    "op2_url_filter": ("pages", "page_id bigint, host string, path string, rule string, verdict string"),
    "op3_warc": ("pages", "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"),
    "op4_decontamination": (None, "doc_id bigint, item_id bigint"),
    "op5_substring_dedup": ("documents", "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"),
    "op6_pii": ("documents", "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"),
    "op7_best_fit_packing": (None, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"),
    "op8_minhash": ("documents", "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean"),
    "op9_shards": ("documents", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"),
    "op10_quality_rules": ("documents", "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"),
}


def test_all_ten_are_registered():
    assert set(registry.QUERIES) == set(CONTRACTS) and set(registry.ORACLES) <= set(CONTRACTS)


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns_and_rows(spark, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    got, (table, wanted) = registry.QUERIES[name](spark, SF), CONTRACTS[name]
    types = dict(got.dtypes)
    for column in wanted.split(", "):
        c, kind = column.split()
        assert types.get(c) == kind, column
    n = got.count()
    assert n > 0
    if table:
        assert n == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert before == {k: spark.conf.get(k, None) for k in before}  # the session stays as the user set it
