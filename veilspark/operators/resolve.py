"""Overlap resolution and ordered splicing of matches, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.spans import disjoint, let, splice

from .detect import MATCH


def resolve_overlaps(matches: Column) -> Column:
    """Sorted, disjoint matches: the earliest start first, then the longest, then the detector registered first; one is kept if it starts at or after the last kept end."""
    return let(F.array_sort(matches), lambda found: disjoint(found, MATCH))


def apply(text: Column, replacements: Column) -> Column:
    """`text` with each (start, end, replacement) of a sorted, disjoint array put in."""
    return let(replacements, lambda new: splice(text, new))
