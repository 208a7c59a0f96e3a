"""Registry of this subpackage's queries and their SQL."""

from . import embeddings, htmltext, licenses, mixing, ngramjoin, packing, sharding, topk, toxicity, urlfilter

_MODULES = [packing, topk, sharding, embeddings, urlfilter, ngramjoin, htmltext, licenses, toxicity, mixing]


def queries() -> dict:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
