"""What the operators work on.  Position is never implied: every row carries its id."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Graph:
    """nodes(id, kind, label, split), edges(src, dst[, w]), features(id, x); label and split are null where unknown."""

    nodes: DataFrame
    edges: DataFrame
    features: DataFrame | None = None
    attrs: dict[str, Any] = field(default_factory=dict)

    def split(self, name: str | None = None) -> DataFrame | dict[str, DataFrame]:
        """The ids of one split, or those of all three by name; where the graph's attributes say so, validation doubles as test."""
        if name is None:
            return {s: self.split(s) for s in ("train", "valid", "test")}
        if name == "test" and self.attrs.get("test_is_valid"):
            name = "valid"
        return self.nodes.where(self.nodes.split == name).select("id")


@dataclass(frozen=True)
class PartitionedGraph:
    """nodes(new_id, old_id, part, label, split), edges(src, dst, sp, dp, block) in new ids, parts(part, start, end), parts count k."""

    nodes: DataFrame
    edges: DataFrame
    parts: DataFrame
    k: int
    features: DataFrame | None = None
    attrs: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Pivots:
    """pivots(pvt, old_id, part); inter(src in new ids, pvt, sp): edges into pivots; intra(src, dst, sp): edges between pivots, as pivot numbers."""

    pivots: DataFrame
    inter: DataFrame
    intra: DataFrame
