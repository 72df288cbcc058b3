"""Small functions of numbers and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def advised_ratio(edges: float, fits: float) -> float:
    """The share of the room for edges to fill with the resident prefix: (10 - edges / fits) / 9, 0.5 where
    that is negative and 1 where it is over 1. Without room the quotient is infinite, so 0.5; 1 if there are no edges either."""
    if not fits:
        return 0.5 if edges else 1.0
    k = (10 - edges / fits) / 9
    return 0.5 if k < 0 else min(k, 1.0)


def edges_that_fit(memory: int, per_vertex: int, n: int, edge_bytes: int) -> int:
    """How many edges memory has room for beside the vertices' state."""
    return max(0, memory - per_vertex * n) // edge_bytes


def dataset_name(path: str) -> str:
    """The file's name without folders and its last suffix."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part.cast("double") / whole)
