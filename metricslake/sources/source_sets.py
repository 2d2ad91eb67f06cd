"""Report sources by specification: copied lake tables and derived tables under one root each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from metricslake.sources import lake

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class SourceSpec:
    """One source: tables copied from a lake and derived tables by the name of their definition."""

    name: str
    tables: tuple[str, ...] = ()
    derived: tuple[str, ...] = ()
    lake_root: str | None = None  # another lake than the default one


def specs_from_records(records: Iterable[Mapping]) -> list[SourceSpec]:
    """Specifications from plain records (``name``, ``tables``, ``derived``, ``lake_root``)."""
    return [
        SourceSpec(r["name"], tuple(r.get("tables", ())), tuple(r.get("derived", ())), r.get("lake_root"))
        for r in records
    ]


def generate_sources(
    spark: SparkSession,
    specs: Iterable[SourceSpec],
    lake_root: str,
    out_root: str,
    definitions: Mapping[str, Builder],
    only: Iterable[str] = (),
) -> dict[str, dict[str, str]]:
    """Refresh each source under ``out_root/<name>``; returns what became of each table.

    ``only`` names the sources to refresh (none: all); an unknown name is an error before
    anything is written. A table that the lake lacks is ``missing``, a derived table without a definition
    ``undefined``; both are skipped and the rest of the source is refreshed.
    """
    specs, wanted = list(specs), set(only)
    unknown = wanted - {s.name for s in specs}
    if unknown:
        raise ValueError(f"unknown source(s): {', '.join(sorted(unknown))}")
    status = {}
    for spec in specs:
        if wanted and spec.name not in wanted:
            continue
        root, out = spec.lake_root or lake_root, f"{out_root.rstrip('/')}/{spec.name}"
        found = lake.copy_tables(spark, root, out, spec.tables)
        known = {n: (lambda b=definitions[n]: b(spark, root)) for n in spec.derived if n in definitions}
        found |= lake.materialize_derived(spark, known, out)
        found |= {n: "undefined" for n in spec.derived if n not in definitions}
        status[spec.name] = found
    return status
