"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from zoomloom.plans import corpus, fetch, marks, pyramids, sessions, shows

MODULES = [fetch, shows, marks, pyramids, sessions, corpus]
FLAGSHIP = "viewport_box"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
