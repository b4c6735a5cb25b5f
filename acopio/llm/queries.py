"""Importing this module registers the query of every operator here, and the pipeline's."""

import corpus_pipeline

from . import (bpe, conversation_trie, doc_sketch, exact_search, fill_middle, html_extract, line_dedup, mixing, pii, quality, simhash, token_counts,  # noqa: F401
               url_filters)
from .registry import ORACLE, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
