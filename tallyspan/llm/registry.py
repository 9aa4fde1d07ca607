"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import fm_index, merkle, mixing, passages, prefix_trie, repeats, rule_ledger, severity, style_tree, surrogates, token_shards, url_rules, weighted_minhash

MODULES = (surrogates, token_shards, passages, url_rules, severity, style_tree, fm_index, mixing, rule_ledger, weighted_minhash, prefix_trie, merkle, repeats)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
