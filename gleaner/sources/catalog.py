"""Graphs by name: a folder of edge lists and their attribute files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators import graph as g
from gleaner.sources import files


@dataclass
class GraphCatalog:
    """Graphs under a root folder: (collection, ..., name) is the file collection/.../name.ij; attributes lie in name.ij_attrs."""

    spark: SparkSession
    root: str
    known: dict[tuple[str, ...], DataFrame] = field(default_factory=dict)

    def path(self, *name: str) -> str:
        return f"{self.root}/{'/'.join(name)}.ij"

    def name(self, path: str) -> tuple[str, ...]:
        return tuple(path.removeprefix(self.root).strip("/").removesuffix(".ij").split("/"))

    def get(self, *name: str, giant_only: bool = False) -> DataFrame:
        """Edges of a graph, its largest component if giant_only; a graph is planned once a catalog."""
        key = (*name, "giant" if giant_only else "")
        if key not in self.known:
            edges = files.edge_list(self.spark, self.path(*name))
            self.known[key] = g.giant_component(edges) if giant_only else edges
        return self.known[key]

    def register(self, edges: DataFrame, *name: str) -> None:
        files.write_edge_list(edges, self.path(*name))
        self.known.pop((*name, ""), None)

    def attribute(self, *name: str, attribute: str, keys: tuple[str, ...] = ()) -> DataFrame:
        return files.attribute(self.spark, f"{self.path(*name)}_attrs/{attribute}", keys)

    def set_attribute(self, values: DataFrame, *name: str, attribute: str) -> None:
        files.write_attribute(values, f"{self.path(*name)}_attrs/{attribute}")
