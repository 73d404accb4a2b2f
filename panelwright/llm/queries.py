"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import OP7_SQL, op7_nearest_neighbours
from .decontaminate import OP10_SQL, op10_decontamination
from .mixing import OP4_SQL, op4_source_mixing
from .html_text import op6_html_extraction
from .near_dups import OP2_SQL, op2_near_duplicates
from .quality import op8_quality_classifier
from .secrets import op1_secret_scan
from .spelling import OP13_SQL, op13_spelling_variants
from .token_files import op9_token_output
from .toxicity import op12_toxicity
from .url_filters import OP5_SQL, op5_url_filters
from .vector_codes import OP11_SQL, op11_vector_codes
from .warc import OP3_SQL, op3_warc_revisits

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_source_mixing": op4_source_mixing,
    "op5_url_filters": op5_url_filters,
    "op6_html_extraction": op6_html_extraction,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_output": op9_token_output,
    "op10_decontamination": op10_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_toxicity": op12_toxicity,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL = {
    "op2_near_duplicates": OP2_SQL,
    "op3_warc_revisits": OP3_SQL,
    "op4_source_mixing": OP4_SQL,
    "op5_url_filters": OP5_SQL,
    "op7_nearest_neighbours": OP7_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_vector_codes": OP11_SQL,
    "op13_spelling_variants": OP13_SQL,
}
