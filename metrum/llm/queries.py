"""The queries of the pipeline's operators, and their SQL where SQL can express them."""

from metrum.llm import alignment, chat, decontamination, languages, licences, near_dedup, pieces, prefix_trie, quality, retrieval, secret_scan, substring_dedup, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_top_k": retrieval.op3_top_k,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_quality": quality.op5_quality,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_chat": chat.op7_chat,
    "op8_pieces": pieces.op8_pieces,
    "op9_licences": licences.op9_licences,
    "op10_languages": languages.op10_languages,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op3_top_k": retrieval.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op7_chat": chat.OP7_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
