"""The queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from roadloom.llm import decontaminate, embedding_dedup, importance, langid, mixing, ngram_lr, packing, pii, prefix_trie, secrets, simhash, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_secrets": secrets.op3_secrets,
    "op4_simhash": simhash.op4_simhash,
    "op5_mixing": mixing.op5_mixing,
    "op6_language_id": langid.op6_language_id,
    "op7_pii": pii.op7_pii,
    "op8_quality": ngram_lr.op8_quality,
    "op9_token_files": token_files.op9_token_files,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_importance": importance.op11_importance,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_packing": packing.op13_packing,
}

#: The others are tested against brute-force versions, exact round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op10_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op11_importance": importance.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
}
