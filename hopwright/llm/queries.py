"""The queries of this subpackage and, where SQL expresses them, their SQL for DuckDB."""

from __future__ import annotations

from hopwright.llm.decontaminate import op9_decontaminate, op9_sql
from hopwright.llm.divergence import op2_divergence, op2_sql
from hopwright.llm.hash_tree import op4_hash_tree, op4_sql
from hopwright.llm.line_dedup import op1_line_dedup, op1_sql
from hopwright.llm.mixing import op8_poisson_mix, op8_sql
from hopwright.llm.pitman_yor import op5_pitman_yor
from hopwright.llm.simhash import op6_simhash
from hopwright.llm.site_template import op3_site_template
from hopwright.llm.token_prefix import op7_token_counts
from hopwright.llm.warc_zstd import op10_sql, op10_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_divergence": op2_divergence,
    "op3_site_template": op3_site_template,
    "op4_hash_tree": op4_hash_tree,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_decontaminate": op9_decontaminate,
    "op10_warc": op10_warc,
}
SQL = {
    "op1_line_dedup": op1_sql(),
    "op2_divergence": op2_sql(),
    "op4_hash_tree": op4_sql(),
    "op8_poisson_mix": op8_sql(),
    "op9_decontaminate": op9_sql(),
    "op10_warc": op10_sql(),
}
