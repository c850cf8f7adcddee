"""Cuts of undirected graphs by joins: a spanning forest, its Euler tour, and what the other edges reach beyond each subtree.

Nothing is walked node by node: the forest grows by merging, the tour is numbered by pointers that reach twice as far each round, and extremes over subtrees are those
of ranges of the tour. So the number of jobs grows with the logarithm of the graph (squared for the forest), whatever its shape, and no component is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.operators import graph as g
from gleaner.operators.table import join_counted, row_numbers
from gleaner.session import discard, materialize, materialize_counted


def _followed(pointers: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Rows (at, to) with `to` where the pointers at -> to end, and their folder; ends point to themselves."""
    now, path = materialize(pointers.select("at", "to"), name)
    while True:
        moved = Observation()
        further = now.select(F.col("at").alias("mid"), F.col("to").alias("end"))
        step = now.join(further, now["to"] == further["mid"]).observe(moved, F.sum((F.col("end") != F.col("to")).cast("long")).alias("n")).select("at", F.col("end").alias("to"))
        nxt, nxt_path = materialize(step, name)
        discard(pointers.sparkSession, path)
        now, path = nxt, nxt_path
        if not moved.get["n"]:
            return now, path


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Rows (src, dst): a spanning forest of the different pairs of edges(src, dst), src < dst; loops and nulls are ignored.

    Each round, every part takes the edge of least hash that leaves it, which can't close a circle, and what is linked becomes one part; there are half as many parts at
    most. Of the edges between two parts one goes on to the next round. A hub's edges are reduced before the shuffle.
    """
    spark = edges.sparkSession
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    edge = F.struct(F.xxhash64("src", "dst").alias("w"), "src", "dst")
    now, path, n = materialize_counted(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b"), edge.alias("e")), "parts")
    taken, paths = None, []
    while n:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        least, least_path = materialize(both.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select("a", "m.b", "m.e"), "least")
        own = least.select("e.src", "e.dst")
        taken = own if taken is None else taken.unionByName(own)
        paths.append(least_path)
        # two parts that take the same edge are the only circle: the smaller one is the end
        back = least.select(F.col("a").alias("b"), F.col("e").alias("other"))
        to = F.when((F.col("e") == F.col("other")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b"))
        ends, ends_path = _followed(least.join(back, "b").select(F.col("a").alias("at"), to.alias("to")), "ends")
        named = now.join(ends.select(F.col("at").alias("a"), F.col("to").alias("p")), "a").join(ends.select(F.col("at").alias("b"), F.col("to").alias("q")), "b")
        merged = named.where("p <> q").groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.min("e").alias("e"))
        nxt, nxt_path, n = materialize_counted(merged, "parts")
        discard(spark, path, ends_path)
        now, path = nxt, nxt_path
    discard(spark, path)
    if taken is None:
        return spark.createDataFrame([], edges.select("src", "dst").schema)
    out, _ = materialize(taken.distinct(), "forest")
    discard(spark, *paths)
    return out


def euler_tour(forest: DataFrame) -> DataFrame:
    """Rows (id, component, parent, first, last) of the trees of forest(src, dst): each rooted at its smallest id, whose parent is null.

    first and last are the places of a node's two arcs from and to its parent on a tour of all arcs of its tree (told from the end of the tour): a node lies below another
    if its first lies between the other's first and last. Arcs are numbered in the order of their ends by ranges, so a hub's arcs are in many tasks; the arc
    that follows one into a node is the next that leaves it. Each arc looks for the least one ahead, the beginning of its tour, twice as far each round.
    """
    spark = forest.sparkSession
    arcs, arcs_path, n = materialize_counted(row_numbers(g.both_ways(forest), ["src", "dst"], "arc"), "arcs")
    leaving = arcs.groupBy("src").agg(F.min("arc").alias("least"), F.max("arc").alias("most"), F.count("*").alias("n"))
    # the arc after (u, v) is the one behind (v, u) among those that leave v, or the first of them
    after = F.when(F.col("arc") == F.col("most"), F.col("least")).otherwise(F.col("arc") + 1)
    follow = join_counted(arcs, leaving, "src", n, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), after.alias("next"))
    start = F.struct("arc", "src").alias("start")
    now, path = materialize(arcs.join(follow, ["src", "dst"]).select("arc", "src", "dst", "next", start, F.lit(0).cast("long").alias("ahead")), "tour")
    span = 1
    while True:
        changed = Observation()
        further = now.select(F.col("arc").alias("mid"), F.col("next").alias("end"), F.col("start").alias("other"), F.col("ahead").alias("more"))
        nearer = F.col("start") <= F.col("other")
        step = now.join(further, now["next"] == further["mid"]).observe(changed, F.sum((~nearer).cast("long")).alias("n"))
        nxt, nxt_path = materialize(
            step.select("arc", "src", "dst", F.col("end").alias("next"), F.least("start", "other").alias("start"), F.when(nearer, F.col("ahead")).otherwise(F.col("more") + span).alias("ahead")), "tour"
        )
        discard(spark, path)
        now, path, span = nxt, nxt_path, 2 * span
        if not changed.get["n"]:  # what is least within any stretch of this length is least of all
            break
    # the first arc of a tour is a whole tour ahead of itself; the earlier arc of an edge leads down
    whole = now.groupBy("start").agg((F.max("ahead") + 1).alias("whole")).select(F.col("start.arc").alias("first_arc"), "whole")
    placed = now.join(whole, now["arc"] == whole["first_arc"], "left").select("src", "dst", F.col("start.src").alias("component"), F.coalesce("whole", "ahead").alias("place"))
    down = placed.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "component").agg(F.max(F.struct("place", "src", "dst")).alias("down"), F.min("place").alias("first"))
    below = down.select(F.col("down.dst").alias("id"), "component", F.col("down.src").alias("parent"), "first", F.col("down.place").alias("last"))
    roots = now.where("arc = start.arc").select(F.col("src").alias("id"), F.col("src").alias("component"), F.lit(None).cast("long").alias("parent"), F.lit(-1).cast("long").alias("first"), F.lit(1 << 62).alias("last"))
    out, _ = materialize(below.unionByName(roots), "tree")
    discard(spark, arcs_path, path)
    return out


def _with_ends(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """edges(src, dst), n of them, with component, and first and last of both ends as f1, l1, f2, l2; a hub's edges are dealt to several tasks."""
    out = edges
    for end, other, i in (("src", "dst", 1), ("dst", "src", 2)):
        count = edges.groupBy(end).agg(F.count("*").alias("n"))
        own = nodes.select(F.col("id").alias(end), *(["component"] if i == 1 else []), F.col("first").alias(f"f{i}"), F.col("last").alias(f"l{i}"))
        out = join_counted(out, own.join(count, end), end, n, other)
    return out


def _above(first: str, last: str, other: str) -> Column:
    return F.col(other).between(F.col(first), F.col(last))


def _reach(nodes: DataFrame, other: DataFrame) -> DataFrame:
    """Rows (id, parent, first, last, low, high) for all nodes but roots: the least and the largest first that edges not in the tree lead to from the node or below it.

    A range of the tour is made of two ranges of powers of two a level at most. Extremes of all those ranges are partial aggregates over the nodes that have such edges.
    """
    reach = other.select("component", F.col("f1").alias("at"), F.col("f2").alias("to")).unionByName(other.select("component", F.col("f2").alias("at"), F.col("f1").alias("to")))
    reach = reach.where("at >= 0")  # roots lie below nobody
    own = reach.groupBy("component", "at").agg(F.min("to").alias("low"), F.max("to").alias("high"))
    top = nodes.where("parent IS NOT NULL").agg(F.max("last")).first()[0] or 1
    blocks = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top.bit_length()))))
    blocks = blocks.groupBy("component", "level", F.expr("shiftright(at, level)").alias("block")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    pieces = F.expr(
        """flatten(transform(sequence(0, CAST(ceil(log2(last - first + 2)) AS INT)), k -> transform(filter(array(
            named_struct('take', shiftright(first + shiftleft(1L, k) - 1, k) % 2 = 1, 'level', k, 'block', shiftright(first + shiftleft(1L, k) - 1, k)),
            named_struct('take', shiftright(last + 1, k) % 2 = 1, 'level', k, 'block', shiftright(last + 1, k) - 1)),
            x -> x.take AND shiftright(first + shiftleft(1L, k) - 1, k) < shiftright(last + 1, k)), x -> named_struct('level', x.level, 'block', x.block))))"""
    )
    below = nodes.where("parent IS NOT NULL")
    asked = below.select("id", "component", F.explode(pieces).alias("p")).select("id", "component", "p.level", "p.block")
    found = asked.join(blocks, ["component", "level", "block"]).groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return below.join(found, "id", "left").select("id", "parent", "first", "last", "low", "high")


def _walked(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(nodes, tree, other): the tour of a spanning forest, _reach of it, and the edges that aren't in it, with their ends; and tables to delete."""
    pairs, pairs_path = materialize(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs")
    forest = spanning_forest(pairs)
    nodes = euler_tour(forest)
    rest, rest_path, n = materialize_counted(pairs.join(forest, ["src", "dst"], "left_anti"), "rest")
    other, other_path = materialize(_with_ends(rest, nodes, n), "other")
    tree, tree_path = materialize(_reach(nodes, other), "reach")
    return nodes, tree, other, [pairs_path, rest_path, other_path, tree_path]


def bridges(edges: DataFrame) -> DataFrame:
    """Rows (src, dst), src < dst: edges whose removal splits their component, that is tree edges below which no other edge leads further.

    Repeated edges, in either direction, count once; loops and nulls are ignored.
    """
    _, tree, _, paths = _walked(edges)
    alone = tree.where("low IS NULL OR (low >= first AND high <= last)")
    out, _ = materialize(alone.select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst")), "bridges")
    discard(edges.sparkSession, *paths)
    return out


def biconnected(edges: DataFrame) -> DataFrame:
    """Rows (block, src, dst), src < dst: the biconnected sets, named by their smallest edge's ends as `src-dst`; a bridge is a set of its own.

    Edges of the tree are named by their lower end. Two of them are in one set if an edge that isn't in the tree joins their ends and neither lies below the other, or if one is above the other
    and an edge leads from below the lower one past the upper one; sets are the components of those links. Other edges belong to that of their lower end.
    Repeated edges, in either direction, count once; loops and nulls are ignored.
    """
    spark = edges.sparkSession
    _, tree, other, paths = _walked(edges)
    upper = tree.select(F.col("id").alias("parent"), F.col("first").alias("f"), F.col("last").alias("l"))
    past = tree.join(upper, "parent").where("low < f OR high > l").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    across = other.where(~_above("f1", "l1", "f2") & ~_above("f2", "l2", "f1")).select("src", "dst")
    sets, sets_path = materialize(g.components(past.unionByName(across)), "sets")
    lower = F.when(_above("f1", "l1", "f2"), F.col("dst")).otherwise(F.col("src"))
    own = tree.select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"), "id").unionByName(other.select("src", "dst", lower.alias("id")))
    count = own.groupBy("id").agg(F.count("*").alias("n"))
    named = count.join(sets, "id", "left").select("id", "n", F.coalesce("component", "id").alias("set"))
    dealt, dealt_path, n = materialize_counted(join_counted(own, named, "id", tree.count() + other.count(), "src").select("set", "src", "dst"), "dealt")
    least = dealt.groupBy("set").agg(F.min(F.struct("src", "dst")).alias("e"), F.count("*").alias("n"))
    least = least.select("set", "n", F.concat_ws("-", "e.src", "e.dst").alias("block"))
    out, _ = materialize(join_counted(dealt, least, "set", n, "src").select("block", "src", "dst"), "blocks")
    discard(spark, *paths, sets_path, dealt_path)
    return out


def articulation_points(edges: DataFrame) -> DataFrame:
    """Rows (id): nodes whose removal splits their component, that is nodes of more than one biconnected set."""
    own = biconnected(edges).select("block", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")


def biconnected_sizes(edges: DataFrame) -> DataFrame:
    """Rows (nodes, blocks): how many biconnected sets of more than one edge have so many nodes."""
    own = biconnected(edges).select("block", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("block").agg(F.count("*").alias("nodes"))
    return own.where("nodes > 2").groupBy("nodes").agg(F.count("*").alias("blocks"))


def without_bridges(edges: DataFrame) -> DataFrame:
    """Rows (nodes, components): sizes of what is left when all bridges are taken away, single nodes left out."""
    kept = edges.join(bridges(edges), ["src", "dst"], "left_anti")
    return g.component_sizes(kept).groupBy("nodes").agg(F.count("*").alias("components"))
