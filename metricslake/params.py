"""Typed report parameters (bound as literals, never spliced into SQL text).

A ``None`` selection means "everything" (the dropdowns select all by default) and
adds no filter.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from metricslake import fixed as fx


@dataclass(frozen=True)
class BenchmarkFilters:
    storage_type: str = "native"
    benchmarks: tuple[str, ...] | None = None
    sf_labels: tuple[str, ...] | None = None
    machines: tuple[str, ...] | None = None
    cpu_archs: tuple[str, ...] | None = None
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    # releases drawn as baselines; the first one orders the per-query table
    pinned_versions: tuple[str, ...] = fx.PINNED_VERSIONS
    run_id: str | None = None  # empty or None: newest run matching the filters


@dataclass(frozen=True)
class CIFilters:
    runners: tuple[str, ...] | None = None
    repos: tuple[str, ...] | None = None
    start: dt.datetime | None = None
    end: dt.datetime | None = None


@dataclass(frozen=True)
class DownloadFilters:
    from_year: int = 2024
    from_week: int = 1
    to_year: int = 2026
    to_week: int = 52
    repository: str = "%"  # LIKE pattern: '%', 'core', 'community'
    top_n: int = 5
    extension: str | None = None  # for the single-extension report

    @property
    def lo(self) -> int:
        return self.from_year * 100 + self.from_week

    @property
    def hi(self) -> int:
        return self.to_year * 100 + self.to_week
