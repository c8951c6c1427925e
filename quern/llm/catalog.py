"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from quern.llm import (
    decontaminate,
    embed_dedup,
    langid,
    lexical,
    license_scan,
    packing,
    secret_scan,
    simhash,
    source_audit,
    token_count,
    toxicity,
    url_filter,
    warc,
)

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_simhash": simhash.op2_simhash,
    "op3_embedding_dedup": embed_dedup.op3_embedding_dedup,
    "op4_packing": packing.op4_packing,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_language_id": langid.op6_language_id,
    "op7_token_counts": token_count.op7_token_counts,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_warc": warc.op10_warc,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_source_divergence": source_audit.op13_source_divergence,
}
ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op3_embedding_dedup": embed_dedup.ORACLE,
    "op5_license_scan": license_scan.ORACLE,
    "op10_warc": warc.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
    "op13_source_divergence": source_audit.ORACLE,
}
