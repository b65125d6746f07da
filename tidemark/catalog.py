"""Every registered query of the analytics engine, with the SQL it is held against."""

from __future__ import annotations

from .plans import account, backtests, desk, market, memory, orders, pit, prices, streams, tools

MODULES = (market, pit, prices, memory, tools, desk, orders, account, backtests, streams)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.SQL.items()}
