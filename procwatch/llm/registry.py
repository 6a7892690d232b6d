"""All queries of this subpackage and their SQL."""

from procwatch.llm import (
    exact_dedup_query,
    language_query,
    leaks_query,
    lexical_query,
    licenses_query,
    mixing_query,
    neardup_query,
    passages_query,
    prefix_trie_query,
    token_files_query,
    topk_query,
    url_rules_query,
    warc_query,
)

_MODULES = (neardup_query, topk_query, licenses_query, passages_query, warc_query,
            url_rules_query, leaks_query, token_files_query, language_query, mixing_query,
            exact_dedup_query, lexical_query, prefix_trie_query)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in _MODULES for name, text in module.ORACLES.items()}
