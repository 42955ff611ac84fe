"""Tenant scope: every query over scoped tables takes one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """An organisation, and optionally a repository, branch and snapshot within it; each names the column it restricts."""

    organization_id: int | str
    repository_id: int | None = None
    branch_id: int | None = None
    snapshot_id: int | None = None

    def of(self, df: DataFrame) -> DataFrame:
        """Rows of df inside the scope. A column of the scope that df lacks is an error, never a wider result."""
        for name, value in vars(self).items():
            if value is not None:
                df = df.filter(F.col(name) == value)
        return df
