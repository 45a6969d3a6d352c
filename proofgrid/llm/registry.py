"""Queries of the training-data operators and their SQL, where SQL can express them."""

from . import archive, chat, decontamination, extraction, jaccard, licenses, media, packing, pieces, quality, resampling, substrings, trie

QUERIES = {
    "op1_chat_rotation": chat.query,
    "op2_substring_dedup": substrings.query,
    "op3_decontamination": decontamination.query,
    "op4_sentencepiece": pieces.query,
    "op5_transport_streams": media.query,
    "op6_jaccard_join": jaccard.query,
    "op7_license_scan": licenses.query,
    "op8_html_extraction": extraction.query,
    "op9_warc": archive.query,
    "op10_quality": quality.query,
    "op11_importance_resampling": resampling.query,
    "op12_packing": packing.query,
    "op13_prefix_trie": trie.query,
}
SQL = {
    "op1_chat_rotation": chat.SQL,
    "op2_substring_dedup": substrings.SQL,
    "op3_decontamination": decontamination.SQL,
    "op6_jaccard_join": jaccard.SQL,
    "op9_warc": archive.SQL,
    "op11_importance_resampling": resampling.SQL,
    "op13_prefix_trie": trie.SQL,
}
