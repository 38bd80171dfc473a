"""All queries over the standard tables, and their DuckDB equivalents."""

from . import run_catalogue, time_catalogue  # noqa: F401  they add theirs
from .catalogue import ORACLE_SQL, QUERIES, forecast_by_part

__all__ = ["ORACLE_SQL", "QUERIES", "forecast_by_part"]
