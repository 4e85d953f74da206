"""The queries of this subpackage and their SQL."""
from __future__ import annotations

from . import exact_dedup, line_dedup, media, minhash, mixing, pieces, sharding, suffix_dedup, toxicity, unit_dedup

QUERIES = {
    "op1_media": media.op1_media,
    "op2_mixing": mixing.op2_mixing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_minhash": minhash.op7_minhash,
    "op8_unit_dedup": unit_dedup.op8_unit_dedup,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_toxicity": toxicity.op10_toxicity,
}

SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_sharding": sharding.OP5_SQL,
    "op7_minhash": minhash.OP7_SQL,
    "op8_unit_dedup": unit_dedup.OP8_SQL,
}
