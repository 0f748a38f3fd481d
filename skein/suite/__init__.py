"""The queries of the retrieval engine by name, with their SQL where SQL can say it."""

from skein.suite import contracts, evaluation, ingest, more, retrieval, state  # noqa: F401
from skein.suite.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
