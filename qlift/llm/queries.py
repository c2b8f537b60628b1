"""The registered queries of this subpackage, with SQL where SQL can express the result."""

from __future__ import annotations

from . import bpe, embed_dedup, fingerprints, langid, mixing, pii, prefix_trie, quality, ranked_search, secrets, simhash, suffix_dedup, toxicity

QUERIES = {
    "op1_embed_dedup": embed_dedup.op1_embed_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_simhash": simhash.op3_simhash,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_pii": pii.op7_pii,
    "op8_langid": langid.op8_langid,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_secrets": secrets.op13_secrets,
}

ORACLES = {
    "op7_pii": pii.OP7_SQL,
    "op1_embed_dedup": embed_dedup.OP1_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_secrets": secrets.OP13_SQL,
}
