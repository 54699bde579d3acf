"""Imports every query module so that the registry is complete."""

from plaudit.plans import registry
from plaudit.plans import q_core  # noqa: F401

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
NOTES = registry.NOTES
from plaudit.plans import q_text  # noqa: F401,E402
from plaudit.plans import q_enrich  # noqa: F401,E402
from plaudit.plans import q_analytics  # noqa: F401,E402
from plaudit.plans import q_sources  # noqa: F401,E402
from plaudit.plans import q_stream  # noqa: F401,E402
from plaudit.plans import q_reports  # noqa: F401,E402
