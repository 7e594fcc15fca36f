"""Registered queries over the given tables, with their SQL equivalents."""

from workload import (  # noqa: F401  (they register their queries)
    tables, preprocessing, peaks, forests, formatting, statistics)
from workload.views import ORACLES, QUERIES  # noqa: F401
