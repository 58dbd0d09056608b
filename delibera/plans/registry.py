"""All queries of the core, with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from delibera.plans import corpus, documents, ledger, mining, panels, quality, records, sampling, sequences, state, warehouse

MODULES = [records, corpus, sequences, panels, mining, sampling, quality, ledger, documents, state, warehouse]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
