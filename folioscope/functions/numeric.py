"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (inclusive) of impact bands 0..3; band 4 is everything above.
IMPACT_BAND_BOUNDS = (2.5, 5.0, 10.0, 15.0)


def nan_to_null(value: Column) -> Column:
    """Missing numbers as SQL NULL; NaN would compare greater than every number."""
    return F.when(~F.isnan(value), value)


def impact_band(factor: Column) -> Column:
    """Right-closed band number of an impact factor; NULL for a missing one."""
    known = nan_to_null(factor)
    band = F.when(known.isNull(), F.lit(None))
    for index, bound in enumerate(IMPACT_BAND_BOUNDS):
        band = band.when(known <= bound, F.lit(index))
    return band.otherwise(F.lit(len(IMPACT_BAND_BOUNDS))).cast("int")


def half_even(value: Column, scale: int = 0) -> Column:
    """Banker's rounding."""
    return F.bround(value, scale)
