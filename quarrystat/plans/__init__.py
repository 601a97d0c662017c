"""Registered queries over the standard tables, each beside its SQL twin."""

from quarrystat.plans import (cleaning, decompositions, elementwise, files, information,  # noqa: F401
                              matrices, models, rows, selections, sparse, statistics)
from quarrystat.plans.registry import ORACLES, QUERIES  # noqa: F401
