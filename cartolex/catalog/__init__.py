"""The query catalogue: importing it registers every module's queries."""

from cartolex.catalog import anchors, identity, keys, lookups, learning, names, planning, search, service, upkeep  # noqa: F401
from cartolex.catalog.registry import ORACLES, QUERIES  # noqa: F401
