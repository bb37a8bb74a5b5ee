"""All rule queries by name, with their SQL."""

from . import counting, drawing, ranking, scoring, trips  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
