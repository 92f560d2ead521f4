"""Queries of the corpus operators and the SQL for those that SQL can express."""

from __future__ import annotations

from evifuse.llm import codes, phrases
from evifuse.llm.codes import op12_vector_codes
from evifuse.llm.decontaminate import op10_decontamination
from evifuse.llm.langid import op9_language_id
from evifuse.llm.packing import op2_packing
from evifuse.llm.phrases import op11_collocations
from evifuse.llm.pii import op5_pii
from evifuse.llm.ppm import op13_lm_score
from evifuse.llm.secrets import op7_secret_scan
from evifuse.llm.simhash import op3_simhash_dedup
from evifuse.llm.substrings import op4_substring_dedup
from evifuse.llm.toxicity import op1_toxicity
from evifuse.llm.urlfilter import op6_url_filter
from evifuse.llm.vectors import op8_embedding_dedup

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_packing, op3_simhash_dedup, op4_substring_dedup, op5_pii, op6_url_filter, op7_secret_scan, op8_embedding_dedup, op9_language_id, op10_decontamination, op11_collocations, op12_vector_codes, op13_lm_score)
}

#: The others return what a model, a tokenizer or an iteration decides: not plain SQL. tests/llm holds the brute-force versions.
ORACLE_SQL: dict[str, str] = {"op11_collocations": phrases.ORACLE, "op12_vector_codes": codes.ORACLE}
