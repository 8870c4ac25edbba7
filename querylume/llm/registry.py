"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from querylume.llm.backoff_lm import op5_backoff_lm
from querylume.llm.block_naming import OP3_SQL, op3_block_naming
from querylume.llm.fill_middle import OP13_SQL, op13_fill_middle
from querylume.llm.fingerprints import op2_fingerprints
from querylume.llm.html_text import op1_html_text
from querylume.llm.language_id import op7_language_id
from querylume.llm.license_scan import op12_license_scan
from querylume.llm.mixing import op10_mix_sources
from querylume.llm.ngram_join import op9_ngram_jaccard_join
from querylume.llm.ranked_search import OP11_SQL, op11_ranked_search
from querylume.llm.sentencepiece_codec import op8_sentencepiece
from querylume.llm.token_files import op4_token_files
from querylume.llm.toxicity import op6_toxicity

_OPS = (
    op1_html_text, op2_fingerprints, op3_block_naming, op4_token_files, op5_backoff_lm, op6_toxicity, op7_language_id,
    op8_sentencepiece, op9_ngram_jaccard_join, op10_mix_sources, op11_ranked_search, op12_license_scan, op13_fill_middle,
)


def queries() -> dict:
    return {f.__name__: f for f in _OPS}


def oracle_sql() -> dict[str, str]:
    return {"op3_block_naming": OP3_SQL, "op11_ranked_search": OP11_SQL, "op13_fill_middle": OP13_SQL}
