"""Operators of a training-data pipeline. Nothing outside this folder imports it."""

from . import bpe, exact_dedup, gif_media, language_id, ngram_join, packing, quality, sharding, suffix_dedup, toxicity

_MODULES = (exact_dedup, gif_media, sharding, bpe, packing, toxicity, ngram_join, suffix_dedup, language_id, quality)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
