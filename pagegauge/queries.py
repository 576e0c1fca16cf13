"""All registered queries of the page-audit operators, and their SQL."""

from __future__ import annotations

from .plans import audits, carriers, layout, markup, records, scores, streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _plan in (records, scores, audits, streams, markup, carriers, layout):
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
