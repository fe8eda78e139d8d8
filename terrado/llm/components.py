"""Connected components of links between documents: the library's own operator under the names used here."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terrado.operators import graph


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links."""
    return graph.connected_components(links, a, b)
