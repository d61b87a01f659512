"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from sitelens.llm import op5_decontaminate as op5
from sitelens.llm import op7_line_frequency as op7
from sitelens.llm.op1_warc import op1_warc_derivatives
from sitelens.llm.op2_bpe import op2_bpe_encode_decode
from sitelens.llm.op3_token_counts import op3_token_counts
from sitelens.llm.op4_language import op4_language_crf
from sitelens.llm.op6_token_files import op6_token_files
from sitelens.llm.op8_quality_pu import op8_quality_pu
from sitelens.llm.op9_suffix_dedup import op9_suffix_dedup
from sitelens.llm.op10_probminhash import op10_probminhash

QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_bpe_encode_decode": op2_bpe_encode_decode,
    "op3_token_counts": op3_token_counts,
    "op4_language_crf": op4_language_crf,
    "op5_decontaminate": op5.op5_decontaminate,
    "op6_token_files": op6_token_files,
    "op7_line_frequency": op7.op7_line_frequency,
    "op8_quality_pu": op8_quality_pu,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_probminhash": op10_probminhash,
}
ORACLE = {
    "op5_decontaminate": op5.SQL,
    "op7_line_frequency": op7.SQL,
}
