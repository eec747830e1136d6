"""All registered queries: name -> (spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from loadcast.catalog import (change_queries, lookup_queries, model_queries, profile_queries,
                              scalar_queries, state_queries, window_queries)

MODULES = [scalar_queries, window_queries, lookup_queries, change_queries, profile_queries,
           model_queries, state_queries]


def all_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out
