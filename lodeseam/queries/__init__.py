"""The query catalogue: one query per operator over the test tables, with its SQL where SQL can express it."""

from __future__ import annotations

from lodeseam.queries import evaluate, ingest, product, search
from lodeseam.queries.corpus import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluate", "ingest", "product", "search"]
