"""All registered queries (importing the catalog modules registers them)."""

from . import catalog_eval, catalog_metrics, catalog_text, catalog_tokens  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
