"""Consolidating pairwise matches into groups by randomised contraction (operators/graph.components)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.skew import HOT_ROWS
from ..operators.graph import components


def connected_components(pairs: DataFrame, a: str, b: str, seed: int = 7) -> DataFrame:
    """(id, group_id) of every id in a pair; group_id is the least id of its group."""
    return components(pairs, a, b, seed, HOT_ROWS)
