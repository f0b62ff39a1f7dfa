"""All registered queries and their SQL: importing the modules registers them."""

from __future__ import annotations

from quern.plans import cases, files, learned, more, queries, stream  # noqa: F401

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
