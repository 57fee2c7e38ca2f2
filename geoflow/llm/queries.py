"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from geoflow.llm import sql
from geoflow.llm.alignment import op13_alignment
from geoflow.llm.bpe import op5_bpe
from geoflow.llm.html import op8_html_text
from geoflow.llm.licenses import op3_license_scan
from geoflow.llm.lines import op9_line_dedup
from geoflow.llm.negatives import op12_hard_negatives
from geoflow.llm.quality import op2_quality
from geoflow.llm.rindex import op4_suffix_dedup
from geoflow.llm.secret_scan import op11_secret_scan
from geoflow.llm.simhash import op7_simhash
from geoflow.llm.sketch import op6_fingerprints
from geoflow.llm.templates import op1_decontamination
from geoflow.llm.token_counts import op10_token_counts


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_quality, op3_license_scan, op4_suffix_dedup, op5_bpe, op6_fingerprints, op7_simhash, op8_html_text, op9_line_dedup, op10_token_counts, op11_secret_scan, op12_hard_negatives, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": sql.OP1, "op4_suffix_dedup": sql.OP4, "op6_fingerprints": sql.OP6, "op7_simhash": sql.OP7, "op11_secret_scan": sql.OP11, "op12_hard_negatives": sql.OP12}
