"""The field calculator: expressions by name, for tables that are worked on by configuration.

Entries take the names of their input columns and return a Column; ``register`` adds more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, planar, text

#: name -> function from column names to a Column.
CALCULATIONS: dict[str, Callable[..., Column]] = {
    "area": lambda ring: planar.ring_area(F.col(ring)),
    "length": lambda ring: planar.ring_length(F.col(ring)),
    "sum angles": lambda ring: planar.angles_summary(F.col(ring), "sum"),
    "min angle": lambda ring: planar.angles_summary(F.col(ring), "min"),
    "max angle": lambda ring: planar.angles_summary(F.col(ring), "max"),
    "min length": lambda ring: planar.side_lengths(F.col(ring), "min"),
    "max length": lambda ring: planar.side_lengths(F.col(ring), "max"),
    "avg length": lambda ring: planar.side_lengths(F.col(ring), "avg"),
    "leading int": text.leading_int,
    "strip digits": text.strip_digits,
    "keep letters": text.keep_letters,
    "keep digits": text.keep_digits,
    "natural pad": text.natural_pad,
    "partition": text.partition_text,
    "date": dates.date_part,
    "time": dates.time_part,
    "degrees minutes seconds": dates.to_dms,
    "degrees minutes": dates.to_dmm,
    "to degrees": dates.from_text,
}


def register(name: str, calculation: Callable[..., Column]) -> None:
    CALCULATIONS[name] = calculation


def calculate(df: DataFrame, name: str, columns: list[str], out: str) -> DataFrame:
    """``df`` with the named calculation of the columns."""
    if name not in CALCULATIONS:
        raise KeyError(f"no calculation {name!r}; there are {', '.join(sorted(CALCULATIONS))}")
    return df.withColumn(out, CALCULATIONS[name](*columns))
