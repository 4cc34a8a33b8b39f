"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from . import bpe_lexicon, chat_rotation, code_compression, exact_dedup, language_id, license_scan, packing, quality_mil, quality_rules, simhash, token_counts, vector_file, warc

QUERIES = {
    "op1_simhash_golay": simhash.op1_simhash_golay,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_warc": warc.op3_warc,
    "op4_language_id": language_id.op4_language_id,
    "op5_quality_mil": quality_mil.op5_quality_mil,
    "op6_chat_rotation": chat_rotation.op6_chat_rotation,
    "op7_bpe_lexicon": bpe_lexicon.op7_bpe_lexicon,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_packing": packing.op10_packing,
    "op11_va_negatives": vector_file.op11_va_negatives,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_weighted_lloyd": code_compression.op13_weighted_lloyd,
}
SQL = {**warc.SQL, **chat_rotation.SQL, **exact_dedup.SQL, **vector_file.SQL, **code_compression.SQL}
