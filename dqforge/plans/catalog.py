"""Every registered query (one per operator of the inventory) and its SQL twin."""

from __future__ import annotations

import importlib

_MODULES = ["q_rules", "q_rowflags", "q_profile", "q_scores", "q_similarity", "q_history", "q_io", "q_stream",
            "q_extra", "q_keyed", "q_snapshot_sql"]


def _load():
    queries, oracle = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"dqforge.plans.queries.{m}")
        dup = set(queries) & set(mod.QUERIES)
        if dup:
            raise RuntimeError(f"duplicate query names: {sorted(dup)}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
