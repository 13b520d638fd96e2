"""Every query that this library registers, with its SQL where there is one."""

from __future__ import annotations

from lodestone.queries import chunking, diagrams, evaluation, geometry, graphs, pages, reports, retrieval, sources, streams, validation
from lodestone.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "chunking", "diagrams", "evaluation", "geometry", "graphs", "pages", "reports", "retrieval", "streams", "validation"]
