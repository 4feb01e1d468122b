"""Spark-native analytics over document knowledge bases."""

from __future__ import annotations


def _load() -> None:
    from notelode.operators import deltas, graph, hamming, hybrid, judgment, links, lists, names, quotes, retrieval, review, scalars, semantic, similarity, stored, summaries, text, topics, upkeep  # noqa: F401
    from notelode.streaming import changes, polling  # noqa: F401


def all_queries() -> dict:
    from notelode.plans.catalog import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    from notelode.plans.catalog import SQL

    _load()
    return dict(SQL)
