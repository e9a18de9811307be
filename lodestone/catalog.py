"""The registered queries and the SQL they are held against."""

from .plans import ORACLE_SQL, QUERIES
from .plans import graphing, searching, storing, structures  # noqa: F401  they register theirs

__all__ = ["ORACLE_SQL", "QUERIES"]
