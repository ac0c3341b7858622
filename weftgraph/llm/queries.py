"""Queries of the subpackage and the SQL that checks those SQL can express."""

from __future__ import annotations

from weftgraph.llm import chat, decontaminate, exact_dedup, infill, ngram_join, packing, pii, resample, secrets, substring_dedup, url_filter, warc
from weftgraph.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_chat_format": chat.op2_chat_format,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
    "op7_warc": warc.op7_warc,
    "op8_packing": packing.op8_packing,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_importance_resampling": resample.op11_importance_resampling,
    "op12_personal_data": pii.op12_personal_data,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op2_chat_format": chat.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op7_warc": warc.ORACLE,
    "op9_benchmark_decontamination": decontaminate.ORACLE,
    "op11_importance_resampling": resample.ORACLE,
    "op13_fill_in_middle": infill.ORACLE,
}
