"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, conversations, exact_dedup, fingerprints, jaccard_join, licenses, line_dedup, merkle, mixing, quality, secrets, sharding, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_secrets": secrets.op3_secrets,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_bpe": bpe.op6_bpe,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality": quality.op8_quality,
    "op9_sharding": sharding.op9_sharding,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_merkle": merkle.op11_merkle,
    "op12_conversations": conversations.op12_conversations,
    "op13_licenses": licenses.op13_licenses,
}
ORACLE_SQL = {"op10_exact_dedup": exact_dedup.ORACLE_SQL, "op11_merkle": merkle.ORACLE_SQL}
