"""The library's queries over the tables, each with SQL for the same rows where SQL can express them."""

from __future__ import annotations

from .registry import ORACLE_SQL, QUERIES  # noqa: F401
from . import algebra, factors, summaries  # noqa: F401, E402  they register their queries
