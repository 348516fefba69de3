"""Dashboard selection as an immutable parameter object (replaces a shared mutable row)."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Literal

Mode = Literal["top", "all", "flop"]

# The dashboard's defaults when nothing has been chosen.
DEFAULT_MODE = "top"
DEFAULT_YEAR = None            # all years
DEFAULT_PRODUCT_CODE = "85123A"
DEFAULT_COUNTRY = "United Kingdom"


@dataclass(frozen=True)
class DashboardParams:
    mode: Mode = DEFAULT_MODE
    year: int | None = DEFAULT_YEAR
    product_code: str = DEFAULT_PRODUCT_CODE
    country: str = DEFAULT_COUNTRY

    def __post_init__(self):
        if self.mode not in ("top", "all", "flop"):
            raise ValueError(f"mode must be top, all or flop, not {self.mode!r}")
        if self.year is not None and not isinstance(self.year, int):
            raise ValueError("year must be an int or None")

    def with_(self, **changes) -> "DashboardParams":
        return replace(self, **changes)
