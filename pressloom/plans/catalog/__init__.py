"""Every checked query by name; importing the package fills the registry."""

from pressloom.plans.catalog import alerts, coverage, evidence, ingest, operations, runs  # noqa: F401
from pressloom.plans.catalog.base import ORACLES, QUERIES  # noqa: F401
