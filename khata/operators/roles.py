"""Which column of a table plays which part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import fixed_values as fv


def role_column(columns: list[str], role: str) -> str | None:
    """The first candidate name of ``role`` that the table has."""
    return next((c for c in fv.ROLES[role] if c in columns), None)


def role_number(columns: list[str], role: str, double_halves: bool = True) -> Column | None:
    """Per row, the first candidate that is neither missing nor zero.

    Half-rate columns (CGST) are doubled to the full rate or amount.
    """
    parts = []
    for c in fv.ROLES[role]:
        if c in columns:
            v = F.nullif(F.col(c).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
            parts.append((v * 2).cast("decimal(18,2)") if double_halves and c in fv.HALF_RATE_COLUMNS else v)
    return F.coalesce(*parts) if parts else None


def role_text(columns: list[str], role: str) -> Column | None:
    """Per row, the first candidate that is neither missing nor empty."""
    parts = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in fv.ROLES[role] if c in columns]
    return F.coalesce(*parts) if parts else None


def table_role(source_table: Column) -> Column:
    """purchase or sales by table name, null for other tables."""
    name = F.lower(source_table)
    return F.when(name.contains("purchase"), "purchase").when(name.contains("sales"), "sales")


def only_role(df: DataFrame, role: str, source_table: str = "source_table") -> DataFrame:
    return df.where(F.lower(source_table).contains(role))
