"""All registered queries of this subpackage."""

from pressloom.llm import block_repeats, bpe, brown, conversation_trie, dart_minhash, decontaminate, hard_negatives, language_id, license_scan, ordinal_quality, quality_rules, suffix_repeats, token_counts  # noqa: F401  importing registers
from pressloom.llm.base import ORACLES, QUERIES  # noqa: F401
