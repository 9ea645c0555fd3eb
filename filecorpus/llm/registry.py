"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from filecorpus.llm import (  # noqa: F401
    context_tree,
    language_id,
    licenses,
    mixing,
    near_duplicates,
    packing,
    phrases,
    prefix_trie,
    quality_classifier,
    quality_rules,
    shingle_join,
    simhash,
    token_files,
)
from filecorpus.llm.common import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
