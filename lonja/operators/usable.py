"""What counts as a usable measurement of a column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lonja.operators.series import has_value


@dataclass(frozen=True)
class Range:
    """Values a column can take: from `low` (or above it, if `open`) to below `high`."""

    low: float
    high: float
    open: bool = False

    def usable(self, c: str | Column) -> Column:
        """True or false, never null. Null and NaN are not usable."""
        col = F.col(c) if isinstance(c, str) else c
        above = col > self.low if self.open else col >= self.low
        return F.coalesce(has_value(col) & above & (col < self.high), F.lit(False))

    def mask(self, v: np.ndarray) -> np.ndarray:
        """The same over numbers in which NaN stands for null."""
        with np.errstate(invalid="ignore"):
            return (v > self.low if self.open else v >= self.low) & (v < self.high)


#: Tonnes of one product in one market and day. No market takes in 5,000 t of one product a day.
MASS = Range(0, 5_000)
#: A price in any scale a source may use: 500 soles a kilogram, per tonne, would be 500,000.
PRICE = Range(0, 500_000, open=True)
