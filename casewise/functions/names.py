"""Scalar expressions on case and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tracer_of(name: Column, rule: str = "substring") -> Column:
    """The tracer that a name spells, by one of three rules.

    substring: fdg_ or psma_ anywhere, else Unknown; prefix: at the start,
    else null; default_psma: fdg unless 'target' is spelled, else PSMA.
    """
    low = F.lower(name)
    if rule == "substring":
        return F.when(low.contains("fdg_"), "FDG").when(low.contains("psma_"), "PSMA").otherwise("Unknown")
    if rule == "prefix":
        return F.when(low.startswith("fdg"), "FDG").when(low.startswith("psma"), "PSMA")
    if rule == "default_psma":
        return F.when(low.contains("target"), "PSMA").when(low.contains("fdg"), "FDG").otherwise("PSMA")
    raise ValueError(rule)


def case_key(path: Column) -> Column:
    """File name without folders, extension, channel or map suffix."""
    base = F.substring_index(F.substring_index(path, "/", -1), ".", 1)
    return F.regexp_replace(base, "(_000[01]|_total_uncertainty)$", "")
