"""The registered queries, each with the SQL that states its result.

Importing this package fills the registry.
"""

from panelspark.catalog import (  # noqa: F401
    aggregates, features, filters, io, joins, metrics, models, scalars, selections, splits,
)
from panelspark.catalog.base import oracle_sql, queries  # noqa: F401
