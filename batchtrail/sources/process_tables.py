"""The process tables as typed DataFrames.

``ProcessTables`` is a plain holder of lazily built DataFrames; operators take
the frames they need as arguments.  ``from_parquet`` reads a deployment laid
out as one Parquet folder per table; ``from_fixtures`` builds the same tables
from the shared test tables (see ``fixtures.py``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from batchtrail.sources.fixtures import fixture
from batchtrail.sources.tables import SCHEMAS, reconcile_schema, scan_table

# process table -> fixture view standing for it
_FIXTURE_VIEWS = {
    "production_runs": "fx_runs",
    "extraction_entries": "fx_extraction",
    "filtration_entries": "fx_filtration",
    "filtration_rows": "fx_filtration_rows",
    "evaporation_entries": "fx_evaporation",
    "evaporation_rows": "fx_evaporation_rows",
    "sheet_entries": "fx_sheets",
    "users": "fx_users",
    "field_change_log": "fx_field_changes",
}


@dataclass
class ProcessTables:
    loader: object
    _cache: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.loader(name)
        return self._cache[name]

    @property
    def runs(self) -> DataFrame:
        return self.table("production_runs")

    @property
    def extraction(self) -> DataFrame:
        return self.table("extraction_entries")

    @property
    def filtration(self) -> DataFrame:
        return self.table("filtration_entries")

    @property
    def filtration_rows(self) -> DataFrame:
        return self.table("filtration_rows")

    @property
    def evaporation(self) -> DataFrame:
        return self.table("evaporation_entries")

    @property
    def evaporation_rows(self) -> DataFrame:
        return self.table("evaporation_rows")

    @property
    def sheets(self) -> DataFrame:
        return self.table("sheet_entries")

    @property
    def users(self) -> DataFrame:
        return self.table("users")

    @property
    def field_changes(self) -> DataFrame:
        return self.table("field_change_log")


def from_parquet(spark: SparkSession, root: str) -> ProcessTables:
    """Tables stored as ``{root}/{table}`` Parquet folders with the declared schemas."""
    return ProcessTables(lambda name: scan_table(spark, f"{root}/{name}", name))


def from_fixtures(spark: SparkSession, sf_dir: str) -> ProcessTables:
    """Tables derived from the shared test tables of ``sf_dir``."""
    def load(name: str) -> DataFrame:
        return reconcile_schema(fixture(spark, sf_dir, _FIXTURE_VIEWS[name]), SCHEMAS[name])
    return ProcessTables(load)
