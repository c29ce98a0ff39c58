"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import filter_audit, fim, ivf_pq, languages, licenses, line_dedup, mixing, ngram_join, passages, pieces, toxicity, url_rules, va_file

QUERIES = {
    "op1_ivf_pq": ivf_pq.op1_ivf_pq,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_language_id": languages.op4_language_id,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
    "op7_shared_passages": passages.op7_shared_passages,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_va_file": va_file.op10_va_file,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_url_rules": url_rules.op13_url_rules,
}
ORACLE_SQL = {
    "op6_ngram_jaccard_join": ngram_join.ORACLE,
    "op7_shared_passages": passages.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_va_file": va_file.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_url_rules": url_rules.ORACLE,
}
