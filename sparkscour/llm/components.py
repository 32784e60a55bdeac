"""Connected components of links, by the library's general helper."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkscour.operators import components as general


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node that each linked node reaches: ``node``, ``component``.

    Tasks contract the links that they hold, so that hardly more than a forest is shuffled. Nodes without
    links aren't listed; links of a node to itself and repeated ones don't matter; no links give no rows.
    """
    return general.components(links, a, b)
