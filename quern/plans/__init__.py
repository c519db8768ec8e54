"""Registered queries: name -> function of (session, folder of tables), and the SQL that checks them."""

from __future__ import annotations

from quern.plans import audits, flows, measures, policy, preprocess, records, retrieval

MODULES = (retrieval, records, measures, policy, flows, audits, preprocess)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
