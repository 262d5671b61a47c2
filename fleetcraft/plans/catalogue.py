"""All registered queries and their DuckDB SQL: importing the query modules registers them."""

from __future__ import annotations

from fleetcraft.plans import queries_driver, queries_mart, queries_segment  # noqa: F401
from fleetcraft.plans.settings import ORACLES, QUERIES  # noqa: F401
