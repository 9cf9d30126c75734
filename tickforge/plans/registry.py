"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from . import grammars, market, passages, pools, research, signals, stores, strategies, streams, trading

MODULES = [market, signals, trading, passages, grammars, pools, research, strategies, streams, stores]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
