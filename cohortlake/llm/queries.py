"""The corpus queries: one per operator, with SQL where SQL can express it."""

from __future__ import annotations

from cohortlake.llm.collocations import OP12_SQL, op12_collocations
from cohortlake.llm.decontamination import op7_decontamination
from cohortlake.llm.html_extraction import OP11_SQL, op11_html_extraction
from cohortlake.llm.language import op10_language
from cohortlake.llm.line_dedup import OP2_SQL, op2_line_dedup
from cohortlake.llm.mixing import op4_mixing
from cohortlake.llm.near_dedup import op9_near_dedup
from cohortlake.llm.quality import op8_quality
from cohortlake.llm.secret_scan import OP6_SQL, op6_secret_scan
from cohortlake.llm.token_store import op5_token_store
from cohortlake.llm.toxicity import op1_toxicity
from cohortlake.llm.vector_search import OP3_SQL, op3_vector_search
from cohortlake.llm.whitening import op13_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_vector_search": op3_vector_search,
    "op4_mixing": op4_mixing,
    "op5_token_store": op5_token_store,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_language": op10_language,
    "op11_html_extraction": op11_html_extraction,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}
ORACLE = {
    "op2_line_dedup": OP2_SQL,
    "op3_vector_search": OP3_SQL,
    "op6_secret_scan": OP6_SQL,
    "op11_html_extraction": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
