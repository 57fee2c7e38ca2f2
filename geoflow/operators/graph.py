"""Road graphs as edges (tile_id, edge_id, u, v, length): joins and groupings over whole tables, no graph in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoflow.functions.geom import line_length
from geoflow.operators.shared import written

#: Values of a one-way tag, the last of them against the way's order (fixed values).
ONEWAY = ("yes", "true", "1", "-1")


def lines_to_graph(lines: DataFrame, points: str = "points", first_id: int = 10000) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines (tile_id, line_id, points): a node per distinct vertex, an edge per segment.

    Node ids count from `first_id` in a tile, by line and place of the first vertex there. Segments of no length and
    later copies of an undirected segment are left out.
    """
    at = lines.select("tile_id", "line_id", F.posexplode(points).alias("pos", "p")).select("tile_id", "line_id", "pos", "p.x", "p.y")
    seen = at.groupBy("tile_id", "x", "y").agg(F.min(F.struct("line_id", "pos")).alias("first"))
    nodes = written(seen.select("tile_id", (F.row_number().over(Window.partitionBy("tile_id").orderBy("first")) + first_id - 1).cast("long").alias("node_id"), "x", "y"), "nodes")
    by = Window.partitionBy("tile_id", "line_id").orderBy("pos")
    named = at.join(nodes, ["tile_id", "x", "y"])
    pairs = named.select("tile_id", "line_id", "pos", F.col("node_id").alias("u"), F.lead("node_id").over(by).alias("v"), "x", "y", F.lead("x").over(by).alias("x2"), F.lead("y").over(by).alias("y2")).where("v IS NOT NULL AND u <> v")
    first = pairs.groupBy("tile_id", F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b")).agg(F.min(F.struct("line_id", "pos", "u", "v", "x", "y", "x2", "y2")).alias("s"))
    length = F.sqrt(F.pow(F.col("s.x2") - F.col("s.x"), 2) + F.pow(F.col("s.y2") - F.col("s.y"), 2))
    edges = first.select("tile_id", F.row_number().over(Window.partitionBy("tile_id").orderBy("s.line_id", "s.pos")).cast("long").alias("edge_id"), "s.u", "s.v", length.alias("length"), F.col("s.x").alias("x1"), F.col("s.y").alias("y1"), "s.x2", "s.y2")
    return nodes, edges


def degrees(edges: DataFrame) -> DataFrame:
    """(tile_id, node_id, degree); a loop counts twice."""
    return edges.select("tile_id", F.explode(F.array("u", "v")).alias("node_id")).groupBy("tile_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))


def terminals(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("degree = 1").select("tile_id", "node_id")


def graph_totals(edges: DataFrame) -> DataFrame:
    """(tile_id, n_nodes, n_edges, length_km)."""
    nodes = degrees(edges).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return edges.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_edges"), (F.sum("length") / 1000).alias("length_km")).join(nodes, "tile_id").select("tile_id", "n_nodes", "n_edges", "length_km")


def without_short_ends(edges: DataFrame, least: float) -> DataFrame:
    """Edges less those that end at a node of degree 1 and are shorter than `least`."""
    ends = terminals(edges)
    hit = edges.where(F.col("length") < least).select("tile_id", "edge_id", F.explode(F.array("u", "v")).alias("node_id")).join(ends, ["tile_id", "node_id"]).select("tile_id", "edge_id").distinct()
    return edges.join(hit, ["tile_id", "edge_id"], "left_anti")


def prune_spurs(edges: DataFrame, least: float, rounds: int = 8) -> DataFrame:
    """`without_short_ends` until nothing changes, at most `rounds` times; loops go."""
    edges = written(edges.where("u <> v"), "edges")
    n = edges.count()
    for _ in range(rounds):
        edges = written(without_short_ends(edges, least), "edges")
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in `nodes` (tile_id, node_id)."""
    kept = nodes.select("tile_id", "node_id").distinct()
    return edges.join(kept.withColumnRenamed("node_id", "u"), ["tile_id", "u"], "left_semi").join(kept.withColumnRenamed("node_id", "v"), ["tile_id", "v"], "left_semi").select(edges.columns)


def node_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(tile_id, node_id, component): the least node reachable. Labels spread along edges and then jump to their own label."""
    both = edges.select("tile_id", "u", "v").union(edges.select("tile_id", F.col("v"), F.col("u"))).distinct()
    both = written(both, "links")
    labels = written(both.groupBy("tile_id", F.col("u").alias("node_id")).agg(F.least(F.first("u"), F.min("v")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node_id", "v"), ["tile_id", "v"]).groupBy("tile_id", F.col("u").alias("node_id")).agg(F.min("component").alias("_near"))
        spread = written(labels.join(near, ["tile_id", "node_id"]).select("tile_id", "node_id", F.col("component").alias("_before"), F.least("component", "_near").alias("component")), "spread")
        jump = spread.select("tile_id", F.col("node_id").alias("component"), F.col("component").alias("_to"))
        labels = written(spread.join(jump, ["tile_id", "component"]).select("tile_id", "node_id", "_before", F.col("_to").alias("component")), "labels")
        if labels.where("component <> _before").isEmpty():
            return labels.select("tile_id", "node_id", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of each tile's component of most nodes, the least component of equals."""
    of = node_components(edges)
    best = of.groupBy("tile_id", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("tile_id").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return induced(edges, of.join(best, ["tile_id", "component"]))


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int = 10_000, directed: bool = False) -> DataFrame:
    """(tile_id, source, node_id, length) from every source (tile_id, node_id) to all nodes it reaches, itself included.

    Distances relax by joins with the edges; only nodes whose distance fell take part in the next round. Edges are gone
    along both ways, `directed` ones from u to v.
    """
    arcs = edges.select("tile_id", "u", "v", "length")
    arcs = arcs if directed else arcs.union(edges.select("tile_id", F.col("v"), F.col("u"), "length"))
    arcs = written(arcs.groupBy("tile_id", "u", "v").agg(F.min("length").cast("double").alias("w")), "arcs")
    known = written(sources.select("tile_id", F.col("node_id").alias("source"), "node_id", F.lit(0.0).alias("length"), F.lit(True).alias("fresh")).distinct(), "paths")
    for _ in range(rounds):
        reach = known.where("fresh").join(arcs.withColumnRenamed("u", "node_id"), ["tile_id", "node_id"]).select("tile_id", "source", F.col("v").alias("node_id"), (F.col("length") + F.col("w")).alias("length"))
        both = known.select("tile_id", "source", "node_id", "length", F.col("length").alias("old")).unionByName(reach.withColumn("old", F.lit(None).cast("double")))
        least = both.groupBy("tile_id", "source", "node_id").agg(F.min("length").alias("length"), F.min("old").alias("old"))
        known = written(least.select("tile_id", "source", "node_id", "length", (F.col("old").isNull() | (F.col("length") < F.col("old"))).alias("fresh")), "paths")
        if known.where("fresh").isEmpty():
            return known.select("tile_id", "source", "node_id", "length")
    raise RuntimeError(f"paths did not settle in {rounds} rounds")


def arcs(ways: DataFrame, both: bool = False) -> DataFrame:
    """The directed multigraph of ways (tile_id, way_id, nodes, oneway, junction): (tile_id, u, v, key, way_id, nth, oneway).

    A way with a oneway tag, or a roundabout, gives an arc from each node to the next, the other way round for the tag
    -1; other ways, or all if `both`, give arcs in both directions. `key` numbers the arcs from u to v, in the order of
    ways, places and directions. Unknown tags count as none.
    """
    tagged = F.coalesce(F.col("oneway").isin(*ONEWAY), F.lit(False))
    single = F.lit(False) if both else tagged | F.coalesce(F.col("junction") == "roundabout", F.lit(False))
    way = ways.select("tile_id", "way_id", F.when(tagged & (F.col("oneway") == "-1") & single, F.reverse("nodes")).otherwise(F.col("nodes")).alias("nodes"), single.alias("oneway"))
    n = F.size("nodes")
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(i.alias("nth"), F.get("nodes", i).alias("a"), F.get("nodes", i + 1).alias("b")))
    steps = way.where(n > 1).select("tile_id", "way_id", "oneway", F.explode(pairs).alias("s")).select("tile_id", "way_id", "oneway", "s.*")
    ends = F.struct(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0).alias("back"))
    turned = F.struct(F.col("b").alias("u"), F.col("a").alias("v"), F.lit(1).alias("back"))
    out = steps.select("tile_id", "way_id", "nth", "oneway", F.explode(F.when(F.col("oneway"), F.array(ends)).otherwise(F.array(ends, turned))).alias("e")).select("tile_id", "way_id", "nth", "oneway", "e.*")
    key = F.row_number().over(Window.partitionBy("tile_id", "u", "v").orderBy("way_id", "nth", "back")) - 1
    return out.select("tile_id", "u", "v", key.alias("key"), "way_id", "nth", "oneway")


def merged_crossings(nodes: DataFrame, arcs: DataFrame, tolerance: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """Crossings nearer than twice `tolerance`, in chains, as one: (nodes (tile_id, node_id, x, y, n), arcs rewired, less loops).

    Dead ends, nodes that one other node is next to, stay by themselves. A merged node has the least id of its nodes and
    their mean place. Arcs between two merged nodes are counted anew by `key`.
    """
    from geoflow.operators.spatial import radius_join

    beside = arcs.select("tile_id", F.col("u").alias("node_id"), F.col("v").alias("w")).union(arcs.select("tile_id", "v", "u")).where("node_id <> w").distinct().groupBy("tile_id", "node_id").agg(F.count(F.lit(1)).alias("d"))
    crossings = nodes.join(beside.where("d > 1"), ["tile_id", "node_id"], "left_semi").select("tile_id", F.col("node_id").alias("id"), "x", "y")
    near = radius_join(crossings, crossings, 2 * tolerance).where("id < other")
    of = node_components(near.select("tile_id", F.col("id").alias("u"), F.col("other").alias("v")))
    named = written(nodes.join(of, ["tile_id", "node_id"], "left").select("tile_id", "node_id", F.coalesce("component", "node_id").alias("to"), "x", "y"), "merged")
    places = named.groupBy("tile_id", F.col("to").alias("node_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    end = lambda c: named.select("tile_id", F.col("node_id").alias(c), F.col("to").alias(f"_{c}"))
    moved = arcs.join(end("u"), ["tile_id", "u"]).join(end("v"), ["tile_id", "v"]).where("_u <> _v")
    key = F.row_number().over(Window.partitionBy("tile_id", "_u", "_v").orderBy("way_id", "nth", "u", "v")) - 1
    return places, moved.select("tile_id", F.col("_u").alias("u"), F.col("_v").alias("v"), key.alias("key"), "way_id", "nth", "oneway")


def without_small_components(edges: DataFrame, least: float, check_up_to: int = 20) -> DataFrame:
    """Edges less components whose longest shortest path is under `least`; those of more than `check_up_to` nodes stay.

    So paths are found in small components only.
    """
    of = written(node_components(edges), "components")
    small = of.groupBy("tile_id", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= check_up_to).select("tile_id", "component")
    nodes = written(of.join(small, ["tile_id", "component"]), "small")
    paths = shortest_paths(induced(edges, nodes), nodes.select("tile_id", "node_id"))
    gone = paths.join(nodes, ["tile_id", "node_id"]).groupBy("tile_id", "component").agg(F.max("length").alias("most")).where(F.col("most") < least)
    drop = nodes.join(gone, ["tile_id", "component"], "left_semi").select("tile_id", F.col("node_id").alias("u"))
    return edges.join(drop, ["tile_id", "u"], "left_anti").select(edges.columns)


def simplify(edges: DataFrame) -> DataFrame:
    """(tile_id, edge_id, u, v, length, n_edges): chains of nodes with two edges become one edge, with the least edge_id.

    Edges that share such a node are linked; the components of those links are the chains. A closed chain is a loop at
    its least node.
    """
    edges = written(edges.select("tile_id", "edge_id", "u", "v", "length"), "edges")
    ends = edges.select("tile_id", "edge_id", F.explode(F.array("u", "v")).alias("node_id"))
    passed = ends.groupBy("tile_id", "node_id").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("a"), F.max("edge_id").alias("b")).where("n = 2")
    chains = node_components(passed.where("a <> b").select("tile_id", F.col("a").alias("u"), F.col("b").alias("v")))
    named = written(edges.join(chains.withColumnRenamed("node_id", "edge_id"), ["tile_id", "edge_id"], "left").withColumn("chain", F.coalesce("component", "edge_id")), "chains")
    stops = named.select("tile_id", "chain", F.explode(F.array("u", "v")).alias("node_id")).join(passed, ["tile_id", "node_id"], "left").groupBy("tile_id", "chain").agg(F.min(F.when(F.col("n").isNull(), F.col("node_id"))).alias("lo"), F.max(F.when(F.col("n").isNull(), F.col("node_id"))).alias("hi"), F.min("node_id").alias("any"))
    total = named.groupBy("tile_id", "chain").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n_edges"))
    return total.join(stops, ["tile_id", "chain"]).select("tile_id", F.col("chain").alias("edge_id"), F.coalesce("lo", "any").alias("u"), F.coalesce("hi", "any").alias("v"), "length", "n_edges")


def chains(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(tile_id, edge_id, u, v, points, length, n_edges): `simplify` with geometry: the points of a chain of edges
    (tile_id, edge_id, u, v, points), points from u to v, joined in order.

    Every edge can be gone along in two ways. A way that ends at a node of two edges leads on to the other edge; pointers
    to the way ahead are doubled until each has its place counted from the end (list ranking), in rounds that follow the
    logarithm of the longest chain. Of a chain's two directions the one from the lesser node counts, or from its lesser
    first edge; a closed chain begins at its least node. A chain has the least edge_id of its edges.
    """
    edges = written(edges.select("tile_id", "edge_id", "u", "v", "points"), "edges")
    ends = edges.select("tile_id", "edge_id", F.explode(F.array("u", "v")).alias("node_id"))
    passed = ends.groupBy("tile_id", "node_id").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("a"), F.max("edge_id").alias("b")).where("n = 2 AND a <> b").drop("n")
    passed = written(passed, "passed")
    linked = node_components(passed.select("tile_id", F.col("a").alias("u"), F.col("b").alias("v")), rounds)
    chain = written(edges.select("tile_id", "edge_id").join(linked.withColumnRenamed("node_id", "edge_id"), ["tile_id", "edge_id"], "left").select("tile_id", "edge_id", F.coalesce("component", "edge_id").alias("chain")), "chain")
    # closed chains stop at their least node
    inner = ends.join(chain, ["tile_id", "edge_id"]).join(passed, ["tile_id", "node_id"], "left").groupBy("tile_id", "chain").agg(F.bool_and(F.col("a").isNotNull()).alias("closed"), F.min("node_id").alias("node_id"))
    passed = passed.join(inner.where("closed").select("tile_id", "node_id"), ["tile_id", "node_id"], "left_anti")
    # ways: an edge and whether it is gone backwards
    way = lambda back, u, v: F.struct(F.struct("edge_id", F.lit(back).alias("back")).alias("way"), F.col(u).alias("from"), F.col(v).alias("to"))
    ways = edges.select("tile_id", F.explode(F.array(way(False, "u", "v"), way(True, "v", "u"))).alias("w")).select("tile_id", "w.*")
    ahead = ways.join(passed.withColumnRenamed("node_id", "to"), ["tile_id", "to"]).select("tile_id", "way", F.col("to").alias("from"), F.when(F.col("way.edge_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
    ahead = ahead.join(ways.select("tile_id", "from", F.col("way").alias("next")), ["tile_id", "from"]).where(F.col("next.edge_id") == F.col("other")).select("tile_id", "way", "next")
    # the last way of a list points to itself
    left = ways.select("tile_id", "way").join(ahead, ["tile_id", "way"], "left")
    ranks = written(left.select("tile_id", "way", F.coalesce("next", "way").alias("next"), F.col("next").isNotNull().cast("long").alias("after")), "ranks")
    for _ in range(rounds):
        on = ranks.select("tile_id", F.col("way").alias("next"), F.col("next").alias("_next"), F.col("after").alias("_after"))
        ranks = written(ranks.join(on, ["tile_id", "next"]).select("tile_id", "way", F.col("_next").alias("next"), (F.col("after") + F.col("_after")).alias("after"), (F.col("next") != F.col("_next")).alias("moved")), "ranks")
        if ranks.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"chains did not end in {rounds} rounds")
    named = chain.withColumnRenamed("edge_id", "_edge")
    placed = ranks.join(ways, ["tile_id", "way"]).withColumn("_edge", F.col("way.edge_id")).join(named, ["tile_id", "_edge"]).select("tile_id", "chain", F.col("next").alias("list"), "way", "after", "from", "to")
    placed = written(placed, "placed")
    lists = placed.groupBy("tile_id", "chain", "list").agg(F.max_by(F.struct("from", "way"), "after").alias("first"))
    best = lists.groupBy("tile_id", "chain").agg(F.min_by("list", "first").alias("list"))
    shapes = edges.select("tile_id", F.col("edge_id").alias("_edge"), "points")
    parts = placed.join(best, ["tile_id", "chain", "list"]).withColumn("_edge", F.col("way.edge_id")).join(shapes, ["tile_id", "_edge"])
    turned = F.when(F.col("way.back"), F.reverse("points")).otherwise(F.col("points"))
    # a chain's points are one value of the result
    row = F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("nth"), turned.alias("points")))).alias("parts")
    out = parts.groupBy("tile_id", "chain").agg(row, F.max_by("from", "after").alias("u"), F.min_by("to", "after").alias("v"), F.count(F.lit(1)).alias("n_edges"))
    joined = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["points"]).otherwise(F.slice(p["points"], 2, 1 << 30))))
    out = out.select("tile_id", F.col("chain").alias("edge_id"), "u", "v", joined.alias("points"), "n_edges")
    return out.select("tile_id", "edge_id", "u", "v", "points", line_length(F.col("points")).alias("length"), "n_edges")


def lines_wkt(edges: DataFrame, tiles: DataFrame | None = None, digits: int = 1) -> DataFrame:
    """(tile_id, edge_id, wkt) of edges with points; tiles of `tiles` (tile_id) without an edge get an empty line and no edge_id."""
    from geoflow.functions.geom import EMPTY_LINE, line_wkt

    out = edges.select("tile_id", "edge_id", line_wkt(F.col("points"), digits).alias("wkt"))
    if tiles is None:
        return out
    none = tiles.select("tile_id").distinct().join(edges.select("tile_id").distinct(), "tile_id", "left_anti")
    return out.unionByName(none.select("tile_id", F.lit(None).cast(edges.schema["edge_id"].dataType).alias("edge_id"), F.lit(EMPTY_LINE).alias("wkt")))


def split_at(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges cut at points (tile_id, edge_id, node_id, part): (tile_id, u, v, length) of the pieces; `part` is 0 to 1 along u to v."""
    stops = edges.select("tile_id", "edge_id", F.explode(F.array(F.struct(F.col("u").alias("node_id"), F.lit(0.0).alias("part")), F.struct(F.col("v").alias("node_id"), F.lit(1.0).alias("part")))).alias("s")).select("tile_id", "edge_id", "s.*")
    all_stops = stops.unionByName(points.select("tile_id", "edge_id", "node_id", "part"))
    by = Window.partitionBy("tile_id", "edge_id").orderBy("part", "node_id")
    pieces = all_stops.select("tile_id", "edge_id", F.col("node_id").alias("u"), F.lead("node_id").over(by).alias("v"), (F.lead("part").over(by) - F.col("part")).alias("share")).where("v IS NOT NULL")
    return pieces.join(edges.select("tile_id", "edge_id", "length"), ["tile_id", "edge_id"]).select("tile_id", "u", "v", (F.col("length") * F.col("share")).alias("length"))


def component_sizes(edges: DataFrame) -> DataFrame:
    """(tile_id, component, n): nodes of each connected set."""
    return node_components(edges).groupBy("tile_id", "component").agg(F.count(F.lit(1)).alias("n"))


def extent(nodes: DataFrame) -> DataFrame:
    """(tile_id, x_min, x_max, y_min, y_max, dx, dy) of nodes (tile_id, x, y)."""
    ends = nodes.groupBy("tile_id").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return ends.withColumn("dx", F.col("x_max") - F.col("x_min")).withColumn("dy", F.col("y_max") - F.col("y_min"))


def with_lengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`edges` with `length`: great-circle metres between their nodes (tile_id, node_id, lat, lon), to three decimals; 0 where a place is missing."""
    from geoflow.functions.coords import great_circle

    at = lambda end: nodes.select("tile_id", F.col("node_id").alias(end), F.col("lat").alias(f"_lat_{end}"), F.col("lon").alias(f"_lon_{end}"))
    both = edges.join(at("u"), ["tile_id", "u"], "left").join(at("v"), ["tile_id", "v"], "left")
    metres = great_circle(F.col("_lat_u"), F.col("_lon_u"), F.col("_lat_v"), F.col("_lon_v"))
    return both.withColumn("length", F.round(F.coalesce(metres, F.lit(0.0)), 3)).drop("_lat_u", "_lon_u", "_lat_v", "_lon_v")
