"""The queries of the operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from srclens.llm import (
    alignment, bit_sliced, block_join, chosen_path, context_tree, conversations, mixing, multi_index, packing, quality,
    quotes, repeats, warc)

MODULES = (
    quotes, mixing, warc, bit_sliced, chosen_path, quality, context_tree, repeats, block_join, packing, alignment,
    multi_index, conversations)


def queries() -> dict:
    out = {name: query for module in MODULES for name, query in module.QUERIES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
