"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import bytepairs, discriminant, divergence, lexical, mixing, neardup, nearest, personal, pieces, repeats, rules, secrets, warc

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_secret_scan": secrets.query,
    "op3_near_duplicates": neardup.query,
    "op4_personal_data": personal.query,
    "op5_quality_discriminant": discriminant.query,
    "op6_nearest_neighbours": nearest.query,
    "op7_warc_bundles": warc.query,
    "op8_sentence_pieces": pieces.query,
    "op9_quality_rules": rules.query,
    "op10_repeated_lines": repeats.query,
    "op11_byte_pairs": bytepairs.query,
    "op12_source_divergence": divergence.query,
    "op13_lexical_search": lexical.query,
}
ORACLE_SQL = {
    "op1_mixing": mixing.SQL,
    "op7_warc_bundles": warc.SQL,
    "op10_repeated_lines": repeats.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_lexical_search": lexical.SQL,
}
