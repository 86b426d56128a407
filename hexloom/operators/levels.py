"""Water levels along a network: the least level that reaches each node, by shortcuts of doubling length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.geo import lit
from hexloom.session import cut_lineage, release


def shortcuts(known: DataFrame) -> list[DataFrame]:
    """Tables k = 0, 1, ... of (id, to, down, up): where 2**k steps of each node's way lead, what they cost, and what the way back costs.

    ``known`` are (src, dst, cost), once for each pair. A node's way goes on by its
    cheapest edge, then to the least node; ``up`` is null if a step has no edge back.
    Nodes whose way ends sooner have no row. On a circle the ways end where they began;
    once all ways that still go on have come to circles, only the circles' own go on.
    """
    way = known.groupBy(F.col("src").alias("id")).agg(F.min(F.struct("cost", "dst")).alias("w")).select("id", F.col("w.dst").alias("to"), F.col("w.cost").alias("down"))
    back = known.select(F.col("dst").alias("id"), F.col("src").alias("to"), F.col("cost").alias("up"))
    found = [cut_lineage(way.join(back, ["id", "to"], "left").select("id", "to", "down", "up"))]
    nodes, last = found[0].count(), found[0]
    places, circles = last.select("to").distinct().count(), False
    while 1 << len(found) <= nodes:
        ahead = last.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("down").alias("down_"), F.col("up").alias("up_"))
        longer = last.join(ahead, "to").where("id != next").select("id", F.col("next").alias("to"), (F.col("down") + F.col("down_")).alias("down"), (F.col("up") + F.col("up_")).alias("up"))
        longer = last = cut_lineage(longer)
        if longer.isEmpty():
            release(longer)
            break
        found.append(longer)
        if not circles:
            before, places = places, longer.select("to").distinct().count()
            circles = places == before
            if circles:  # so many steps lead the places that so many steps lead to onto one another
                nodes, last = places, longer.join(longer.select(F.col("to").alias("on")).distinct(), F.col("id") == F.col("on"), "left_semi")
    return found


def _lowered(levels: DataFrame, offers: DataFrame, tolerance: float) -> DataFrame:
    """``levels`` (id, level, fresh) after ``offers`` (dst, offer), written anew; ``fresh`` are those that fell."""
    least = offers.groupBy("dst").agg(F.min("offer").alias("offer"))
    lower = F.coalesce(F.col("offer") + lit(tolerance) < F.col("level"), F.col("level").isNull() & F.col("offer").isNotNull())
    joined = levels.join(least, F.col("id") == F.col("dst"), "left")
    out = cut_lineage(joined.select("id", F.when(lower, F.col("offer")).otherwise(F.col("level")).alias("level"), lower.alias("fresh")))
    release(levels)
    return out


def settle_levels(nodes: DataFrame, edges: DataFrame, tolerance: float = 0.0, offers_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, level): each node's level lowered to that of any node that leads to it plus the costs on the way.

    ``nodes`` are (id, level), ``edges`` (src, dst, cost) with costs of 0 or more. The
    ways of all nodes make trees (some end in a circle), in which any path goes down and
    then up again. Their ``shortcuts`` stand beside the edges, so that a stretch of n
    steps down or up is at most log n of them; without them it would take n rounds. Each
    table of shortcuts is first followed once, from the shortest down to the shortest
    up again, which settles the trees. In a round, nodes that were lowered in the one
    before (in the first, all) offer their level along edges, and from the second round
    on along shortcuts too, and rounds go on until none falls: trees take one round, a
    network as many for each change from one tree to another.

    Edges without either node, or whose cost is null, do nothing; parallel ones count by
    the cheapest; a node without a level takes what reaches it; repeated nodes count by
    the least level. A fall within ``tolerance`` is none. No nodes give no rows.

    ``offers_of`` stands for edges that are not rows: in each round it takes the levels
    (id, level, fresh) and returns what reaches nodes from fresh ones, as (dst, offer).
    It carries levels far, so that there are no shortcuts with it: rounds follow the
    edges alone.
    """
    known_nodes = nodes.select("id").distinct()
    for end in ("src", "dst"):  # a shortcut must not lead through a place that is no node
        edges = edges.join(known_nodes, edges[end] == known_nodes["id"], "left_semi")
    known = cut_lineage(edges.where("src != dst and cost is not null").groupBy("src", "dst").agg(F.min(F.col("cost").cast("double")).alias("cost")))
    hops, down, up = [], [], []
    if offers_of is None:
        hops = shortcuts(known)
        down = [h.select(F.col("id").alias("src"), F.col("to").alias("dst"), F.col("down").alias("cost")) for h in hops]
        # where no step has a way back, no shortcut has
        back = hops if not hops[0].where("up is not null").isEmpty() else []
        up = [h.where("up is not null").select(F.col("to").alias("src"), F.col("id").alias("dst"), F.col("up").alias("cost")) for h in back]
    levels = cut_lineage(nodes.groupBy("id").agg(F.min(F.col("level").cast("double")).alias("level")).withColumn("fresh", F.col("level").isNotNull()))
    sent = lambda ways, some: ways.join(levels.where(some), F.col("src") == F.col("id")).select("dst", (F.col("level") + F.col("cost")).alias("offer"))
    every = None
    if offers_of is None:
        for ways in [*down, *up[::-1]]:
            levels = _lowered(levels, sent(ways, "level is not null"), tolerance)
        levels = _lowered(levels, sent(known, "level is not null"), tolerance)
    while not levels.where("fresh").isEmpty():
        if every is None and hops:
            every = known
            for ways in [*down[1:], *up[1:]]:
                every = every.unionByName(ways)
            every = cut_lineage(every)
        offers = sent(every if hops else known, "fresh")
        if offers_of:
            offers = offers.unionByName(offers_of(levels))
        levels = _lowered(levels, offers, tolerance)
    release(known, *hops, *([every] if every is not None else []))
    return levels.drop("fresh")
