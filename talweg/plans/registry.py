"""All registered queries of the retrieval engine and their SQL twins."""

from __future__ import annotations

from talweg.plans import catalogues, fulltext, pipelines, routing, search, texts, vectors  # noqa: F401
from talweg.plans._sql import ORACLES, QUERIES  # noqa: F401
