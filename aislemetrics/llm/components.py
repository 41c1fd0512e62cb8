"""Connected components of a graph given by its links, by local contraction.

In each round every node joins the neighbour (or itself) that a hash of the round puts first, and the links are redrawn
between the nodes that others joined.  The number of nodes falls by a constant factor a round, whatever the shape of the
graph, so long chains and large stars need a few rounds too.  Every round's map is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import stored


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): one root for each component.

    Links may be repeated and may join a node to itself; links with a null end are ignored.
    """
    edges = links.select("a", "b").where("a is not null and b is not null")
    size = edges.count()
    maps: list[DataFrame] = []
    while True:
        # Both directions and the node itself; the smallest hash wins, summed up on the map side.
        pairs = [F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in ("ab", "ba", "aa", "bb")]
        both = edges.select(F.explode(F.array(*pairs)).alias("e"))
        order = F.struct(F.xxhash64("e.other", F.lit(len(maps))), "e.other")
        joined = both.groupBy(F.col("e.node").alias("node")).agg(F.min_by("e.other", order).alias("root"))
        maps.append(stored(joined, "component-map", 2 * size))
        a, b = (maps[-1].select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        redrawn = (
            edges.join(a, "a")
            .join(b, "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        edges = stored(redrawn, "component-links", size)
        size = edges.count()
        if not size:
            break
    roots = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return roots
