"""Queries of the training-data operators and the SQL that some of them are held against."""

from __future__ import annotations

from .bpe import op6_byte_bpe
from .chat import OP1_SQL, op1_chat_windows
from .classifier import op8_quality
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .licenses import OP3_SQL, op3_license_scan
from .lm_score import op4_context_mixing
from .minhash_dedup import OP10_SQL, op10_minhash_dedup
from .mixing import OP9_SQL, op9_source_mix
from .vector_dedup import OP5_SQL, op5_vector_dedup
from .warc import OP2_SQL, op2_warc_dictionary

QUERIES = {
    "op1_chat_windows": op1_chat_windows,
    "op2_warc_dictionary": op2_warc_dictionary,
    "op3_license_scan": op3_license_scan,
    "op4_context_mixing": op4_context_mixing,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality": op8_quality,
    "op9_source_mix": op9_source_mix,
    "op10_minhash_dedup": op10_minhash_dedup,
}

ORACLES = {
    "op1_chat_windows": OP1_SQL,
    "op2_warc_dictionary": OP2_SQL,
    "op3_license_scan": OP3_SQL,
    "op5_vector_dedup": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_source_mix": OP9_SQL,
    "op10_minhash_dedup": OP10_SQL,
}
