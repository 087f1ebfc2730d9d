"""The controlled vocabulary of lithology classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names in vocabulary order; the index of an evidence class is its place.
CLASSES = (
    "TOPSOIL", "MADE_GROUND", "PEAT", "CLAY", "SILT", "SAND", "GRAVEL", "MARL", "MUDSTONE", "SILTSTONE",
    "SANDSTONE", "LIMESTONE", "IRONSTONE", "COAL", "CHALK", "NO_RECOVERY", "UNKNOWN",
)
NON_EVIDENCE = ("NO_RECOVERY", "UNKNOWN")
EVIDENCE = tuple(c for c in CLASSES if c not in NON_EVIDENCE)
# Voxel codes that are no class, and the stand-in for a missing prediction.
AIR, UNCONSTRAINED, MISSING = 255, 254, "__MISSING__"


def class_name(index: Column) -> Column:
    """Name of a class index; null outside the vocabulary."""
    return F.get(F.lit(list(CLASSES)).cast("array<string>"), index.cast("int"))


def class_index(name: Column) -> Column:
    """Index of a class name; null if it isn't one."""
    at = F.array_position(F.lit(list(CLASSES)).cast("array<string>"), name)
    return F.when(at > 0, (at - 1).cast("int"))


def is_evidence(name: Column) -> Column:
    return name.isin(*EVIDENCE)
