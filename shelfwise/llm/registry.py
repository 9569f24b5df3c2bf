"""The corpus operators' queries and oracle SQL by name."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, filters, htmltext, infill, minhash, repair, sharding, token_counts, toxicity, urls, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_sharding": sharding.op2_sharding,
    "op3_warc": warc.op3_warc,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_minhash": minhash.op5_minhash,
    "op6_url_filter": urls.op6_url_filter,
    "op7_html_text": htmltext.op7_html_text,
    "op8_token_ids": repair.op8_token_ids,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_bpe": bpe.op10_bpe,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_filter_audit": filters.op13_filter_audit,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_url_filter": urls.oracle_sql(),
    "op11_fill_in_middle": infill.ORACLE_SQL,
    "op13_filter_audit": filters.ORACLE_SQL,
}
