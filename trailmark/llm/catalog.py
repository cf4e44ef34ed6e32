"""Queries of the subpackage and their SQL."""

from trailmark.llm.html import op2_html_blocks
from trailmark.llm.jaccard import join_sql, op9_partenum_join
from trailmark.llm.language import op5_language_id
from trailmark.llm.mixing import mix_sql, op8_source_mixing
from trailmark.llm.phrases import hits_sql, op10_decontamination
from trailmark.llm.quality import op7_quality_divergence
from trailmark.llm.tokens import op1_token_counts, op3_token_files
from trailmark.llm.toxicity import op6_toxicity
from trailmark.llm.urls import op4_url_rules

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_html_blocks": op2_html_blocks,
    "op3_token_files": op3_token_files,
    "op4_url_rules": op4_url_rules,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_quality_divergence": op7_quality_divergence,
    "op8_source_mixing": op8_source_mixing,
    "op9_partenum_join": op9_partenum_join,
    "op10_decontamination": op10_decontamination,
}
ORACLES = {"op8_source_mixing": mix_sql(), "op9_partenum_join": join_sql(), "op10_decontamination": hits_sql()}
