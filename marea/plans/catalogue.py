"""All registered queries."""

from marea.plans import queries_core, queries_evidence, queries_linking, queries_more, queries_store, queries_upkeep  # noqa: F401
from marea.plans.registry import ORACLES, QUERIES  # noqa: F401
