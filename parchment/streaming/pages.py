"""Matches over a stream of documents: pages are searched as they come, in append mode.

Exact, folded, stemmed and fuzzy matching needs one page at a time, so a stream needs no
state for it. The split-word fallback needs a whole document and belongs to the batch that
runs over the sink once a document is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from parchment.operators import search as S
from parchment.sources.tables import pages


def stream_matches(docs: DataFrame, terms: list[str], case_sensitive: bool = False) -> DataFrame:
    """docs: a streaming (or batch) table of documents. One row for each match and tier."""
    plain = [(n, t) for n, t in enumerate(terms) if S.query_kind(t) == "tokens"]
    pg = S.with_tokens(pages(docs))
    return S.token_tiers(pg, plain, case_sensitive)
