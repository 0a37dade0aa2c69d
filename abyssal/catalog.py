"""Registered queries of the library's operators, and their SQL."""

from .plans import models, response, seafloor, series, station, streams  # noqa: F401  (register their queries)
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "welch_psd_median"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
