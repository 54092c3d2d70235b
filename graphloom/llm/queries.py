"""All queries of this subpackage and their SQL."""

from . import binary_output, conversation_trie, embedding_blocks, filter_audit, fingerprints, language, media, mixing, near_duplicates, packing, secrets, sharding, toxicity

MODULES = (fingerprints, sharding, toxicity, packing, near_duplicates, media, language, secrets, mixing, binary_output, embedding_blocks, conversation_trie, filter_audit)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
