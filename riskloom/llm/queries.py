"""Registered queries of this package and their DuckDB twins."""

from . import (
    bpe, chat_format, exact_dedup, language_id, line_dedup, mixing, packing, permutation_index, pii, secret_scan, signature_join, spelling,
    token_alignment,
)

QUERIES = {
    "op1_byte_bpe": bpe.bpe_round_trip,
    "op2_mixture": mixing.mixture,
    "op3_secret_scan": secret_scan.secret_scan,
    "op4_line_dedup": line_dedup.line_dedup,
    "op5_exact_dedup": exact_dedup.exact_dedup,
    "op6_personal_data": pii.personal_data,
    "op7_chat_format": chat_format.chat_format,
    "op8_jaccard_join": signature_join.jaccard_join,
    "op9_language_id": language_id.language_id,
    "op10_permutation_index": permutation_index.permutation_search,
    "op11_spelling_variants": spelling.spelling_variants,
    "op12_best_fit_packing": packing.best_fit_packing,
    "op13_tokenizer_alignment": token_alignment.tokenizer_alignment,
}
ORACLES = {
    "op4_line_dedup": line_dedup.LINE_DEDUP_SQL,
    "op2_mixture": mixing.MIXTURE_SQL,
    "op5_exact_dedup": exact_dedup.EXACT_DEDUP_SQL,
}
