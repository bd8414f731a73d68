"""All registered queries."""

from __future__ import annotations

from plumbline.plans import advising, charting, cleaning, fitted, modelling, profiling, round_trips
from plumbline.plans.fixtures import Catalog

CATALOG: Catalog = {
    **profiling.CATALOG,
    **cleaning.CATALOG,
    **charting.CATALOG,
    **advising.CATALOG,
    **modelling.CATALOG,
    **round_trips.CATALOG,
    **fitted.CATALOG,
}
