"""Keys in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_parts(name: Column) -> Column:
    """(prefix, x, y) of `{catalog}_{scene}_{x}_{y}`, with or without folder and suffix."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[A-Za-z]+$", "")
    part = lambda k: F.regexp_extract(stem, r"^(.+)_(\d+)_(\d+)$", k)
    return F.struct(part(1).alias("prefix"), part(2).try_cast("int").alias("x"), part(3).try_cast("int").alias("y"))


def tile_name(prefix: Column, x: Column, y: Column) -> Column:
    return F.format_string("%s_%d_%d", prefix, x, y)


def stem(path: Column) -> Column:
    """The file name without folder and last suffix."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")
