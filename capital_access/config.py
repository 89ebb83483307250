"""Settings of one study: the area level, who is compared, and the years."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class StudyConfig:
    """``area`` is the code level ("cbsa" or "stco"); gaps compare peers and targets."""

    area: str = "cbsa"
    peers: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    include_targets: bool = True
    first_year: int = 2014
    n_years: int = 5
    panel_years: tuple[int, int] = (2013, 2018)

    @property
    def code(self) -> str:
        return f"{self.area}_code"

    @property
    def label(self) -> str:
        return f"{self.area}_name"

    @property
    def keys(self) -> list[str]:
        return [self.code, self.label]

    @property
    def compared(self) -> list[str]:
        extra = self.targets if self.include_targets else ()
        return list(dict.fromkeys((*self.peers, *extra)))

    def in_area(self) -> Column:
        """Rows of the compared set, as a predicate on the area code."""
        return F.col(self.code).isin(self.compared)


def select_codes(
    crosswalk: DataFrame, code: str, where: Column, excluding: list[str] | None = None
) -> DataFrame:
    """Distinct codes of the crosswalk rows that satisfy ``where``, less an exclusion list.

    The result stays a table and is applied with a semi-join, so a long list
    never passes through the driver.
    """
    picked = crosswalk.filter(where)
    if excluding:
        picked = picked.filter(~F.coalesce(F.col(code).isin(excluding), F.lit(False)))
    return picked.select(code).distinct()
