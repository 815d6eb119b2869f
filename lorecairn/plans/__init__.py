"""Driver queries, registered by topic."""

from . import changes, content, links, searching, vectors  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
