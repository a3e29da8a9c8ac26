"""Parameters of an analysis; the defaults fit records from 1986 to 2025."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Year windows, quantiles and window lengths of one analysis."""

    climatology: tuple[int, int] = (1991, 2020)
    first_year_max: int | None = 1986
    rolling_rows: int = 15
    hot_quantile: float = 0.90
    min_run: int = 2
    wet_quantile: float = 0.95
    max_lag: int = 7
    rows_ahead: int = 7
    base: tuple[int, int] = (1986, 2023)
    target: tuple[int, int] = (2024, 2025)
    record_year: int = 2024
    dropped_year: int = 2026
    last_early_year: int = 2000
    replicates: int = 10_000
    seed: int = 42

    @property
    def base_label(self) -> str:
        return f"{self.base[0]}-{self.base[1]}"

    @property
    def target_label(self) -> str:
        return f"{self.target[0]}-{self.target[1]}"


STANDARD = Settings()

# The trade tables run from 1995 to 2001.
TRADE = Settings(
    climatology=(1995, 2000),
    first_year_max=1995,
    base=(1995, 1999),
    target=(2000, 2001),
    record_year=2000,
    dropped_year=2001,
    last_early_year=1997,
    replicates=200,
)
