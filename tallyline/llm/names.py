"""Working column names that cannot clash with an input's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """``df`` with those of its columns that have a name in ``own`` renamed to ``<name>_input``, so that nothing of them is lost."""
    taken, found = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower() in own:
            name = f"{c}_input"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            found[c] = name
    return df.withColumnsRenamed(found)
