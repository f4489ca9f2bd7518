"""Named queries over the driver tables (see ``registry``)."""

from vantage.plans.registry import REGISTRY, Query, query  # noqa: F401
from vantage.plans import (access, budgets, errors, ingest, listings, logs, overview, profiles, records, reports,  # noqa: F401
                           tables, telemetry, upgrade, environments)


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)
