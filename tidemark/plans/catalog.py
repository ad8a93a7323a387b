"""Every registered query of the analytics engine."""

from . import queries_facts, queries_functions, queries_io, queries_rows, queries_sources, queries_state, queries_views  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
