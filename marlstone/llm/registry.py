"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from marlstone.llm import contamination, minhash, packing, pii, quality, secrets, shards, substrings, urls, warc

QUERIES = {
    "op4_decontamination": contamination.op4_decontamination,
    "op3_warc": warc.op3_warc,
    "op9_shards": shards.op9_shards,
    "op2_url_filter": urls.op2_url_filter,
    "op1_secret_scan": secrets.op1_secret_scan,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_pii": pii.op6_pii,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_minhash": minhash.op8_minhash,
    "op10_quality_rules": quality.op10_quality_rules,
}
#: Models, compression, tokenizers and hash orders are beyond SQL; tests/llm holds these to brute-force
#: versions, and the base columns of op1, op6 and op10 to plain expressions or SQL.
ORACLES: dict[str, str] = {
    "op2_url_filter": urls.SQL,
    "op3_warc": warc.SQL,
    "op4_decontamination": contamination.SQL,
    "op5_substring_dedup": substrings.SQL,
    "op8_minhash": minhash.SQL,
}
