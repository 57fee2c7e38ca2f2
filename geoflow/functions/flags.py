"""Flood flags and booleans as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as "not flooded" on a building and as "flooded" in a mask.
NOT_FLOODED = ("no", "0", "No", "false", "False", "None")
FLOODED = ("yes", "1", "True")


def building_flag(flag: Column) -> Column:
    """A building is flooded unless its tag is missing or says no."""
    return F.coalesce(~flag.cast("string").isin(*NOT_FLOODED), F.lit(False))


def road_flag(flag: Column) -> Column:
    """A road is flooded if it has the tag at all, whatever the tag says."""
    return flag.isNotNull()


def mask_class(flag: Column) -> Column:
    """2 for flooded, 1 for all else."""
    return F.when(flag.cast("string").isin(*FLOODED), 2).otherwise(1)


def as_bool(text: Column) -> Column:
    """'true', 'false' and 'null' in any case as a boolean; NULL for the rest."""
    low = F.lower(F.trim(text.cast("string")))
    return F.when(low == "true", True).when(low == "false", False)


def as_text(flag: Column) -> Column:
    """A boolean as submission text: 'True', 'False' or 'Null'."""
    return F.when(flag, "True").when(~flag, "False").otherwise("Null")
