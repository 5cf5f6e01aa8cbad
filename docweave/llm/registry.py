"""Queries and SQL of this package, for the driver's entry module."""

from docweave.llm.bpe import op1_byte_bpe
from docweave.llm.decontaminate import op9_decontaminate
from docweave.llm.fill_middle import op13_fill_middle
from docweave.llm.html_main import op3_html_extract
from docweave.llm.language_id import op4_language_id
from docweave.llm.lexical import op11_lexical_search
from docweave.llm.licenses import op5_license_scan
from docweave.llm.line_dedup import op12_line_dedup
from docweave.llm.lm_score import op8_lm_score
from docweave.llm.near_dup import op6_minhash_near_dup
from docweave.llm.oracles import SQL
from docweave.llm.quality_model import op2_quality_classifier
from docweave.llm.quality_rules import op10_quality_rules
from docweave.llm.repeats import op7_suffix_dedup

QUERIES = (op1_byte_bpe, op2_quality_classifier, op3_html_extract, op4_language_id, op5_license_scan, op6_minhash_near_dup, op7_suffix_dedup, op8_lm_score, op9_decontaminate, op10_quality_rules, op11_lexical_search, op12_line_dedup, op13_fill_middle)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return dict(SQL)
