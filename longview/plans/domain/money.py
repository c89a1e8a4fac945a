"""Money settings shared by the pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from longview.functions import scalars as S


@dataclass(frozen=True)
class Money:
    """Price level, present-value year and discount rate."""
    dollar_year: int = 2021
    pv_year: int = 2022
    rate: float = 0.05

    def inflate(self, c) -> Column:
        return S.inflate(c, self.dollar_year)

    def discount(self, c, year="year") -> Column:
        return S.discount(c, year, self.rate, self.pv_year)
