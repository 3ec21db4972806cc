"""Sources of different columns brought to one schema, the source set as a literal."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """How one source feeds the common columns; columns it doesn't feed become typed NULLs, never invented values."""

    entity: str
    columns: dict[str, Column] = field(default_factory=dict)


def harmonise(sources: dict[str, tuple[DataFrame, Mapping]], schema: dict[str, str]) -> DataFrame:
    """(source, entity, *schema) of all sources in one table; a mapping to a column outside the schema is an error."""
    parts = []
    for name, (df, mapping) in sources.items():
        unknown = set(mapping.columns) - set(schema)
        if unknown:
            raise ValueError(f"{name} feeds unknown columns: {sorted(unknown)}")
        parts.append(df.select(F.lit(name).alias("source"), F.lit(mapping.entity).alias("entity"), *[mapping.columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in schema.items()]))
    return reduce(DataFrame.unionByName, parts)
