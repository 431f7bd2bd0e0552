"""Every named query over the given tables, each beside the SQL it must agree with."""

from orrery.catalogue.registry import ORACLES, QUERIES  # noqa: F401
from orrery.catalogue import (  # noqa: F401
    scalars, predicates, aggregations, joins, lod, windows, timeintel, sets, sources, rollups,
    security, audit, streams, models,
)
