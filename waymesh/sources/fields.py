"""Plan-time field resolution: names match without case, doubled values merge or fail."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FieldConflict(ValueError):
    """A required field is missing."""


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Project ``df`` to ``wanted`` names, each filled from its candidates matched by casefold.

    Equal or single non-null candidates merge; differing non-null values stop the job.
    """
    by_fold: dict[str, list[str]] = {}
    for column in df.columns:
        by_fold.setdefault(column.casefold(), []).append(column)
    projected = []
    for name, candidates in wanted.items():
        folds = dict.fromkeys(c.casefold() for c in [name, *candidates])
        found = [column for fold in folds for column in by_fold.get(fold, [])]
        if not found:
            raise FieldConflict(f"no column for {name} among {df.columns}")
        merged = F.coalesce(*[F.col(f"`{c}`") for c in found])
        if len(found) > 1:
            differs = F.exists(F.array(*[F.col(f"`{c}`") for c in found]), lambda x: x != merged)
            merged = F.when(F.coalesce(differs, F.lit(False)),
                            F.raise_error(F.lit(f"conflicting values for {name}"))).otherwise(merged)
        projected.append(merged.alias(name))
    return df.select(*projected)


def alias_with_conflict(df: DataFrame, name: str, alias: str, fail: bool = False) -> DataFrame:
    """Merge ``alias`` into ``name``; report rows where both are set and differ, or fail on them."""
    conflict = F.coalesce(F.col(name) != F.col(alias), F.lit(False))
    merged = F.coalesce(F.col(name), F.col(alias))
    if fail:
        merged = F.when(conflict, F.raise_error(F.lit(f"{name} and {alias} differ"))).otherwise(merged)
    return df.withColumns({name: merged, "conflict": conflict}).drop(alias)
