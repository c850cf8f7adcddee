"""Graph operators on two DataFrames: edges (src, dst), undirected with src < dst unless said otherwise, and node tables (id, ...).

Iterations write each round to the shared folder, which cuts the lineage. Wedges are opened from the end of lower degree, so a
hub's neighbours aren't paired with each other.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.columns import POLICIES
from gleaner.operators.table import jaccard_pairs, join_counted, numbered_groups, row_numbers
from gleaner.session import discard, materialize, materialize_counted


def edges_from(df: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct undirected edges without loops, src < dst; nulls go."""
    s, t = F.col(source), F.col(target)
    return df.where(s != t).select(F.least(s, t).alias("src"), F.greatest(s, t).alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    flip = F.explode(F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(flip.alias("e")).select("e.src", "e.dst")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def network(df: DataFrame, source: str, target: str, edge_columns: Sequence[str] = (), node_policies: dict[str, tuple[str, str]] | None = None, order: str = "") -> tuple[DataFrame, DataFrame]:
    """A directed multigraph of a table: edges keep their columns; node attributes are aggregated over all rows an end occurs in."""
    edges = df.select(F.col(source).alias("src"), F.col(target).alias("dst"), *edge_columns)
    ends = df.select(F.explode(F.array(source, target)).alias("id"), *dict.fromkeys([v for _, v in (node_policies or {}).values()] + ([order] if order else [])))
    if not node_policies:
        return edges, ends.select("id").distinct()
    return edges, ends.groupBy("id").agg(*(POLICIES[p](F.col(v), F.col(order)).alias(n) for n, (p, v) in node_policies.items()))


# Degrees and edits


def degrees(edges: DataFrame) -> DataFrame:
    """Rows (id, degree)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("nodes"))


def max_degree_node(edges: DataFrame) -> DataFrame:
    """The node of largest degree; ties go to the largest id."""
    return degrees(edges).agg(F.max(F.struct("degree", "id")).alias("m")).select("m.id", "m.degree")


def edge_counts(directed: DataFrame) -> DataFrame:
    """One row: unique directed, undirected and reciprocated edges, and loops, of a directed multigraph (src, dst)."""
    pairs = directed.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.max((F.col("src") <= F.col("dst")).cast("int")).alias("up"), F.max((F.col("src") >= F.col("dst")).cast("int")).alias("down"), F.count("*").alias("n")
    )
    loop = F.col("a") == F.col("b")
    return pairs.agg(
        F.sum(F.when(loop, 1).otherwise(F.col("up") + F.col("down"))).alias("unique_directed"),
        F.count("*").alias("unique_undirected"),
        F.sum(F.when(~loop & (F.col("up") + F.col("down") == 2), 1).otherwise(0)).alias("reciprocated"),
        F.sum(F.when(loop, F.col("n")).otherwise(0)).alias("loops"),
    )


def has_node(edges: DataFrame, node: int) -> bool:
    return not edges.where((F.col("src") == node) | (F.col("dst") == node)).isEmpty()


def has_edge(edges: DataFrame, a: int, b: int) -> bool:
    return not edges.where((F.col("src") == min(a, b)) & (F.col("dst") == max(a, b))).isEmpty()


def directed_degrees(arcs: DataFrame) -> DataFrame:
    """Rows (id, in_degree, out_degree) of directed arcs (src, dst)."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return arcs.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def undirected(arcs: DataFrame) -> DataFrame:
    """Arcs in both directions, once each."""
    return both_ways(arcs).distinct()


def with_loops(edges: DataFrame) -> DataFrame:
    """Edges and a loop on every node."""
    return edges.select("src", "dst").unionByName(nodes_of(edges).select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def without_degree(edges: DataFrame, k: int) -> DataFrame:
    """Edges that touch no node of degree k; for k = 0 all of them, as a node without edges isn't in an edge table."""
    return without_nodes(edges, degrees(edges).where(F.col("degree") == k))


def tree_root(arcs: DataFrame) -> DataFrame:
    """Rows (id): ends that no arc (from parent to child) leads to; one row for a tree."""
    return arcs.select(F.col("src").alias("id")).distinct().join(arcs.select(F.col("dst").alias("id")), "id", "left_anti")


def random_subgraph(edges: DataFrame, n: int, seed: int) -> DataFrame:
    """Edges among n nodes drawn by a hash."""
    return induced(edges, nodes_of(edges).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n))


def edge_subgraph(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of wanted(src, dst), in either direction, that are edges."""
    own = wanted.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return edges.join(own, ["src", "dst"], "left_semi")


def random_edge_subgraph(edges: DataFrame, m: int, seed: int) -> DataFrame:
    """m edges drawn by a hash."""
    return edges.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(m)


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with neither end in nodes(id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti").join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def renumbered(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Edges under the new numbers(id, number) of their ends."""
    a, b = numbers.select(F.col("id").alias("src"), F.col("number").alias("s")), numbers.select(F.col("id").alias("dst"), F.col("number").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst"))


def ego_net(edges: DataFrame, node: int) -> DataFrame:
    """Edges among a node and its neighbours."""
    near = both_ways(edges).where(F.col("src") == node).select(F.col("dst").alias("id"))
    return induced(edges, near.unionByName(near.sparkSession.range(1).select(F.lit(node).cast(near.schema["id"].dataType).alias("id"))))


def is_tree(edges: DataFrame) -> bool:
    n, m = nodes_of(edges).count(), edges.count()
    return n > 0 and m == n - 1 and components(edges).select("component").distinct().count() == 1


# Triangles


def _oriented(edges: DataFrame) -> DataFrame:
    """Edges from the end of lower (degree, id) to the other."""
    d = degrees(edges)
    e = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("d1")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("d2")), "dst")
    up = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("src") < F.col("dst")))
    return e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("hi"))


def triangles(edges: DataFrame) -> DataFrame:
    """Rows (a, b, c): each triangle once."""
    o = _oriented(edges)
    wedges = o.alias("x").join(o.alias("y"), F.col("x.lo") == F.col("y.lo")).where(F.col("x.hi") < F.col("y.hi")).select(F.col("x.lo").alias("a"), F.col("x.hi").alias("b"), F.col("y.hi").alias("c"))
    return wedges.join(edges, (F.col("b") == F.col("src")) & (F.col("c") == F.col("dst")), "left_semi")


def triangle_counts(edges: DataFrame) -> DataFrame:
    """Rows (id, triangles), for nodes in one at least."""
    return triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """Rows (id, degree, triangles, cc): closed pairs of neighbours over all of them, 0 below degree 2."""
    d = F.col("degree")
    found = degrees(edges).join(triangle_counts(edges), "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)).cast("long"))
    return found.withColumn("cc", F.when(d < 2, 0.0).otherwise(2.0 * F.col("triangles") / (d.cast("double") * (d - 1))))


def triads(edges: DataFrame) -> DataFrame:
    """One row: nodes, mean clustering, closed triads (triangles) and open ones."""
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    c = clustering(edges).agg(F.count("*").alias("nodes"), F.avg("cc").alias("cc"), (F.sum("triangles") / 3).cast("long").alias("closed"), F.sum(pairs).alias("pairs"))
    return c.select("nodes", "cc", "closed", (F.col("pairs") - 3 * F.col("closed")).cast("long").alias("open"))


def triad_edges(edges: DataFrame) -> DataFrame:
    """Rows (src, dst, triangles): edges that are in a triangle, and in how many."""
    sides = F.array(*(F.struct(F.least(F.col(x), F.col(y)).alias("src"), F.greatest(F.col(x), F.col(y)).alias("dst")) for x, y in (("a", "b"), ("b", "c"), ("a", "c"))))
    return triangles(edges).select(F.explode(sides).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("triangles"))


def node_triads(edges: DataFrame) -> DataFrame:
    """Rows (id, closed, open): pairs of a node's neighbours that are linked, and that aren't."""
    pairs = (F.col("degree") * (F.col("degree") - 1) / 2).cast("long")
    return clustering(edges).select("id", F.col("triangles").alias("closed"), (pairs - F.col("triangles")).alias("open"))


def clustering_by_degree(edges: DataFrame) -> DataFrame:
    return clustering(edges).groupBy("degree").agg(F.avg("cc").alias("cc"), F.count("*").alias("nodes"))


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (a, b, n) for pairs(a, b): neighbours that both have."""
    adj = both_ways(edges)
    x = pairs.join(adj.select(F.col("src").alias("a"), F.col("dst").alias("via")), "a")
    hit = x.join(adj.select(F.col("src").alias("b"), F.col("dst").alias("via")), ["b", "via"])
    return pairs.join(hit.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def knn_jaccard(bipartite: DataFrame, k: int) -> DataFrame:
    """Rows (src, other, similarity, rank): the k sources of directed edges (src, dst) most alike by the Jaccard index of what they point to; ties by id."""
    own = bipartite.select(F.struct("src").alias("key"), F.col("dst").alias("v")).where("key.src is not null").distinct()
    rows, groups, n = numbered_groups(own)
    both = jaccard_pairs(rows, groups, n).where("g1 <> g2")
    s = both.select("g1", "g2", (F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))).alias("similarity"))
    best = s.withColumn("rank", F.row_number().over(Window.partitionBy("g1").orderBy(F.desc("similarity"), "g2"))).where(F.col("rank") <= k)
    one, two = groups.select(F.col("g").alias("g1"), F.col("key.src").alias("src")), groups.select(F.col("g").alias("g2"), F.col("key.src").alias("other"))
    return best.join(one, "g1").join(two, "g2").select("src", "other", "similarity", "rank")


# Components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (id, component) for each node with an edge: the smallest id it reaches. Edges may be any pairs (src, dst); loops and nulls are ignored.

    Alternates large-star and small-star rounds until a round changes nothing. A round needs only a minimum for each node, combined before the
    shuffle, and a hub's neighbours are dealt to several tasks (see join_counted), so it isn't gathered; a round is one job, which writes its edges
    and sums up their hashes on the way.
    """
    spark = edges.sparkSession
    pairs = edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()

    def written(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        seen = Observation()
        out, path = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("mark")), "edges")
        return out, path, (seen.get["n"], seen.get["mark"])

    now, path, last = written(pairs)
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = join_counted(both.where("v > u"), low, "u", 2 * last[0], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, "u", 2 * last[0], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        nxt, nxt_path, mark = written(small.where("u <> v").distinct())
        discard(spark, path)
        now, path = nxt, nxt_path
        if mark == last:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        last = mark
    raise RuntimeError("components did not settle")


def component_sizes(edges: DataFrame) -> DataFrame:
    return components(edges).groupBy("component").agg(F.count("*").alias("nodes"))


def giant_component(edges: DataFrame) -> DataFrame:
    """Edges of the largest component; ties go to the smallest label."""
    labels, _ = materialize(components(edges), "labels")
    best = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return induced(edges, labels.join(best, "component", "left_semi").select("id"))


def strong_components(directed: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Rows (id, component) of directed edges (src, dst): the smallest id of each strongly connected set.

    Nodes fall into parts, at first one. A round drops nodes that no arc of their part leads to or from, each a component of its own, and takes a random pivot
    of each part: what it reaches both forwards and backwards is a component, and the nodes that it reaches one way, the other, or not at all make new
    parts, as no component lies across them. So the number of rounds grows with the logarithm of the nodes, a round's joins with the length of paths.
    It goes on until no node is left; with max_rounds, it raises if nodes are left after so many.
    """
    spark = directed.sparkSession
    arcs, arcs_path = materialize(directed.where("src <> dst").select("src", "dst").distinct(), "arcs")
    nodes, nodes_path = materialize(directed.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("part", F.lit(0).cast("long")), "parts")
    done, at = None, 0
    while not nodes.isEmpty():
        if at == max_rounds:
            raise RuntimeError("strong_components did not settle")
        both = arcs.select(F.col("src").alias("id")).distinct().join(arcs.select(F.col("dst").alias("id")).distinct(), "id")
        live, live_path = materialize(nodes.join(both, "id", "left_semi"), "parts")
        pivots = live.groupBy("part").agg(F.min_by("id", F.xxhash64("id", F.lit(at))).alias("id"))
        ahead, ahead_paths = _reach(pivots, arcs)
        back, back_paths = _reach(pivots, arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        marked = live.join(ahead.select("id", F.lit(1).alias("f")), "id", "left").join(back.select("id", F.lit(1).alias("b")), "id", "left")
        marked, marked_path = materialize(marked.select("id", "part", F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("b", F.lit(0)).alias("b")), "parts")
        member = marked.where("f + b = 2")
        found = member.join(member.groupBy("part").agg(F.min("id").alias("component")), "part").select("id", "component")
        alone = nodes.join(live, "id", "left_anti").select("id", F.col("id").alias("component"))
        found, _ = materialize(found.unionByName(alone), "members")
        done = found if done is None else done.unionByName(found)
        rest = marked.where("f + b < 2").select("id", F.xxhash64("part", "f", "b", F.lit(at)).alias("part"))
        nxt, nxt_path = materialize(rest, "parts")
        ends = arcs.join(nxt.select(F.col("id").alias("src"), F.col("part").alias("p")), "src").join(nxt.select(F.col("id").alias("dst"), F.col("part").alias("q")), "dst")
        left, left_path = materialize(ends.where("p = q").select("src", "dst"), "arcs")
        discard(spark, arcs_path, nodes_path, live_path, marked_path, *ahead_paths, *back_paths)
        nodes, nodes_path, arcs, arcs_path, at = nxt, nxt_path, left, left_path, at + 1
    return done if done is not None else spark.createDataFrame([], "id long, component long")


def _reach(roots: DataFrame, arcs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows (id) that arcs lead to from roots(id, ...), those included; and the tables that they are read from."""
    reached, path = materialize(roots.select("id"), "reach")
    frontier, paths = reached, [path]
    while True:
        step = arcs.join(frontier, F.col("src") == F.col("id")).select(F.col("dst").alias("id")).distinct()
        frontier, path = materialize(step.join(reached, "id", "left_anti"), "reach")
        paths.append(path)
        if frontier.isEmpty():
            return reached, paths
        reached = reached.unionByName(frontier)


def k_core(edges: DataFrame, k: int, max_rounds: int = 10_000) -> DataFrame:
    """Edges left when nodes of degree below k are peeled off until none remains."""
    now, path, n = materialize_counted(edges, "core")
    for _ in range(max_rounds):
        weak = degrees(now).where(F.col("degree") < k).select("id")
        nxt, nxt_path, left = materialize_counted(without_nodes(now, weak), "core")
        settled, n = left == n, left
        discard(edges.sparkSession, path)
        now, path = nxt, nxt_path
        if settled:
            return now
    raise RuntimeError("k_core did not settle")


def k_core_sizes(edges: DataFrame, most: int) -> DataFrame:
    """Rows (k, nodes, edges) of the cores 1 .. most, each from the one before."""
    out, now = [], edges
    for k in range(1, most + 1):
        now = k_core(now, k)
        m = now.count()
        out.append((k, nodes_of(now).count(), m))
        if not m:
            break
    return edges.sparkSession.createDataFrame(out, "k int, nodes long, edges long")


# Paths


def hops(edges: DataFrame, sources: DataFrame, depth: int | None = None, directed: bool = False, enough: int | None = None) -> DataFrame:
    """Rows (source, id, hop) by breadth-first frontiers from sources(id), up to depth; with enough, a source goes no further after the level that brings it so many nodes.

    Without directions a frontier's neighbours lie on its own level or on one next to it, so they are held against two levels and not against all that was reached.
    """
    adj = edges.select("src", "dst") if directed else both_ways(edges)
    reached, _ = materialize(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hop")), "hops")
    frontier, before, at = reached, None, 0
    while depth is None or at < depth:
        at += 1
        step = frontier.join(adj, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id")).distinct()
        known = reached if directed else frontier if before is None else frontier.unionByName(before)
        new, _ = materialize(step.join(known.select("source", "id"), ["source", "id"], "left_anti").withColumn("hop", F.lit(at)), "hops")
        if new.isEmpty():
            break
        frontier, before = new, frontier
        reached = reached.unionByName(frontier)
        if enough is not None:
            frontier = frontier.join(reached.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") < enough).select("source"), "source", "left_semi")
    return reached


def nodes_at_hops(edges: DataFrame, source: DataFrame) -> DataFrame:
    return hops(edges, source).groupBy("source", "hop").agg(F.count("*").alias("nodes"))


def shortest_path(edges: DataFrame, source: int, target: int) -> int | None:
    """Hops between two nodes; None if there is no way."""
    start = edges.select(F.lit(source).cast("long").alias("id")).limit(1)
    row = hops(edges, start).where(F.col("id") == target).select("hop").first()
    return None if row is None else row["hop"]


def bfs_tree(edges: DataFrame, source: DataFrame, depth: int | None = None) -> DataFrame:
    """Rows (id, parent, hop): the least neighbour one hop nearer."""
    h = hops(edges, source, depth).select("id", "hop")
    up = h.join(both_ways(edges), F.col("id") == F.col("src")).join(h.select(F.col("id").alias("dst"), F.col("hop").alias("near")), "dst").where("near = hop - 1")
    parent = up.groupBy("id").agg(F.min("dst").alias("parent"))
    return h.join(parent, "id", "left").select("id", "parent", "hop")


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """Rows (id, size) of a tree (id, parent, hop): nodes at or below each one, level by level from the deepest."""
    levels = [r["hop"] for r in tree.select("hop").distinct().orderBy(F.desc("hop")).collect()]  # a row a level
    done, below = None, None
    for hop in levels:
        own = tree.where(F.col("hop") == hop).select("id", "parent")
        if below is not None:
            own = own.join(below, own["id"] == below["up"], "left").select("id", "parent", (F.lit(1) + F.coalesce("n", F.lit(0))).cast("long").alias("size"))
        else:
            own = own.withColumn("size", F.lit(1).cast("long"))
        own, _ = materialize(own, "subtrees")
        below = own.groupBy(F.col("parent").alias("up")).agg(F.sum("size").alias("n"))
        done = own if done is None else done.unionByName(own)
    return done.select("id", "size")


def full_diameter(distances: DataFrame) -> DataFrame:
    """One row (diameter, mean): the longest and the mean distance of hops() between different nodes."""
    return distances.where("hop > 0").agg(F.max("hop").alias("diameter"), F.avg("hop").alias("mean"))


def effective_diameter(distances: DataFrame, percentile: float = 0.9) -> float:
    """Interpolated hop within which a share of the reached pairs lie, pairs of a node with itself included."""
    counts = distances.groupBy("hop").count().orderBy("hop").collect()
    total, seen, before = sum(r["count"] for r in counts), 0, (0, 0)
    for r in counts:
        seen += r["count"]
        if seen >= percentile * total:
            low = before[1]
            return float(r["hop"]) if seen == low else float(r["hop"]) - 1 + (percentile * total - low) / (seen - low) if r["hop"] else 0.0
        before = (r["hop"], seen)
    return 0.0


def distance_measures(distances: DataFrame, n_nodes: int) -> DataFrame:
    """Rows (source, reached, farness, closeness, closeness_normalized, eccentricity) from hops()."""
    r, total = F.col("reached"), F.col("total")
    own = distances.groupBy("source").agg(F.count("*").alias("reached"), F.sum("hop").alias("total"), F.max("hop").alias("eccentricity"))
    far = F.when(r > 1, total / (r - 1)).otherwise(0.0)
    wide = far * (n_nodes - 1) / (r - 1)
    return own.select(
        "source", "reached", far.alias("farness"), F.when(r > 1, 1 / far).otherwise(0.0).alias("closeness"), F.when(r > 1, 1 / wide).otherwise(0.0).alias("closeness_normalized"), "eccentricity"
    )


def weighted_distances(arcs: DataFrame, sources: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Rows (source, id, distance) along directed arcs (src, dst, weight >= 0), relaxed until nothing gets nearer."""
    now, path = materialize(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance"), F.lit(True).alias("new")), "near")
    for _ in range(max_rounds):
        step = now.where("new").join(arcs, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id"), (F.col("distance") + F.col("weight")).alias("d"))
        step = step.groupBy("source", "id").agg(F.min("d").alias("d"))
        nxt = now.drop("new").join(step, ["source", "id"], "full").select(
            "source", "id", F.least(F.coalesce("distance", "d"), F.coalesce("d", "distance")).alias("distance"), (F.col("distance").isNull() | (F.col("d") < F.col("distance"))).alias("new")
        )
        nxt, nxt_path = materialize(nxt.withColumn("new", F.coalesce("new", F.lit(False))), "near")
        done = nxt.where("new").isEmpty()
        discard(arcs.sparkSession, path)
        now, path = nxt, nxt_path
        if done:
            return now.drop("new")
    raise RuntimeError("distances did not settle")


#: Pairs of a source and a node that are on disk at once (a block of sources at least), and those that a task holds at once.
PAIRS, CELL_PAIRS = 1 << 28, 1 << 20
#: Arcs of a graph that a task may hold, at 4 bytes each; and pairs of a source and a node that it goes through at once, a source at least.
TASK_ARCS, TASK_PAIRS = 1 << 23, 1 << 20


def betweenness(edges: DataFrame, sources: DataFrame, block: int = 1024) -> DataFrame:
    """Rows (id, betweenness) summed over sources(id), each pair counted once (halved), by breadth-first levels of path counts.

    Up to TASK_ARCS arcs, tasks hold the graph and share the sources out. Beyond that, a level's row is a node with those of `block` sources that reach it there, as lists, so edges and
    not pairs are joined; lists meet in cells of a block and a range of nodes, where they are summed up, and neither a graph nor a source's paths sit in one task. The work is that of all pairs.
    """
    names, total = _over_blocks(edges, sources, block, False)
    found = total.groupBy("v").agg((F.sum("flow") / 2).alias("betweenness"))
    return found.join(names, "v").select("id", "betweenness")


def edge_betweenness(edges: DataFrame, sources: DataFrame, block: int = 1024) -> DataFrame:
    """Rows (src, dst, betweenness): as betweenness, for the shortest paths that run over each edge."""
    names, total = _over_blocks(edges, sources, block, True)
    ends = total.groupBy(F.least("v", "other").alias("a"), F.greatest("v", "other").alias("b")).agg((F.sum("flow") / 2).alias("betweenness"))
    src, dst = names.select(F.col("v").alias("a"), F.col("id").alias("src")), names.select(F.col("v").alias("b"), F.col("id").alias("dst"))
    found = ends.join(src, "a").join(dst, "b").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "betweenness")
    return edges.select("src", "dst").join(found, ["src", "dst"], "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))


def _over_blocks(edges: DataFrame, sources: DataFrame, block: int, over_edges: bool) -> tuple[DataFrame, DataFrame]:
    """(names, flows): nodes with their numbers (id, v), and what the shortest paths from sources bring: (v, flow), or (v, other, flow) over edges."""
    spark = edges.sparkSession
    names, _, n_nodes = materialize_counted(row_numbers(nodes_of(edges), ["id"], "v"), "nodes")
    ends = both_ways(edges).join(names.withColumnRenamed("id", "src"), "src").select(F.col("v").alias("from"), "dst")
    arcs, _, n_arcs = materialize_counted(ends.join(names.withColumnRenamed("id", "dst"), "dst").select("from", F.col("v").alias("to")), "arcs")
    starts, _, n_sources = materialize_counted(row_numbers(names.join(sources.select("id"), "id"), ["id"], "at").select("v", "at"), "sources")
    whole = n_arcs <= TASK_ARCS
    wave = max(1, n_sources) if whole else max(1, PAIRS // (block * max(n_nodes, 1))) * block
    total = None
    for low in range(0, max(n_sources, 1), wave):
        some = starts.where((F.col("at") >= low) & (F.col("at") < low + wave)).withColumn("at", F.col("at") - low)
        paths: list[str] = []
        part, _ = materialize(_dependencies(arcs, some, n_nodes, min(wave, n_sources - low), block, paths, over_edges, whole), "betweenness")
        discard(spark, *paths)
        total = part if total is None else total.unionByName(part)
    return names, total


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]]]:
    """Each cell of batches sorted by (cell, kind), with its pieces, split by kind 0 and 1."""

    def pieces() -> Iterator[tuple[int, pa.RecordBatch, pa.RecordBatch]]:
        for b in batches:
            cell, kind = b["cell"].to_numpy(), b["kind"].to_numpy()
            for lo, hi in itertools.pairwise(np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))):
                cut = lo + int(np.searchsorted(kind[lo:hi], 1))
                yield int(cell[lo]), b.slice(lo, cut - lo), b.slice(cut, hi - cut)

    for cell, own in itertools.groupby(pieces(), key=lambda p: p[0]):
        yield cell, ((known, come) for _, known, come in own)


def _places(piece: pa.RecordBatch, width: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair in a piece's lists its place in the cell, and for each row how many it has."""
    n = pc.list_value_length(piece["source"]).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(piece["v"].to_numpy() % width * block, n) + piece["source"].flatten().to_numpy(), n


def _lists(cell: int, parts: int, width: int, block: int, hit: np.ndarray, value: np.ndarray, flow: np.ndarray | None) -> pa.RecordBatch:
    """A cell's places with their values, as a row a node, and the sum of its flow."""
    node, source = np.divmod(hit, block)
    first = np.flatnonzero(np.diff(node, prepend=-1))
    offsets = pa.array(np.append(first, len(hit)).astype(np.int32))
    sums = np.zeros(len(first)) if flow is None else np.add.reduceat(flow, first)
    at, none = cell // parts, pa.nulls(len(first), pa.int64())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (source.astype(np.int32), value)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), at)), pa.array(cell % parts * width + node[first]), *lists, none, pa.array(sums)], _LISTS)


#: A row of a level: a node, the sources of a block that reach it there, and a value for each; or, with `other` set, the flow between two nodes.
_LISTS = ["block", "v", "source", "value", "other", "flow"]
_LISTS_SCHEMA = "block long, v long, source array<int>, value array<double>, other long, flow double"


def _next_level(batches: Iterator[pa.RecordBatch], parts: int, width: int, block: int) -> Iterator[pa.RecordBatch]:
    """Sums of the path counts that come to a cell (kind 1), where the two levels before (kind 0) don't have the pair."""
    for cell, pieces in _cells(batches):
        paths, known = np.zeros(width * block), np.zeros(width * block, dtype=bool)
        for before, come in pieces:
            if before.num_rows:
                known[_places(before, width, block)[0]] = True
            if come.num_rows:
                paths += np.bincount(_places(come, width, block)[0], come["value"].flatten().to_numpy(), width * block)
        hit = np.flatnonzero((paths > 0) & ~known)
        if len(hit):
            yield _lists(cell, parts, width, block, hit, paths[hit], None)


def _level_back(batches: Iterator[pa.RecordBatch], parts: int, width: int, block: int, over_edges: bool) -> Iterator[pa.RecordBatch]:
    """A level's (kind 0) flows out of the shares that come from the level below it (kind 1): rows with the share that each pair passes on, and the flow over each edge."""
    for cell, pieces in _cells(batches):
        paths, gained = np.zeros(width * block), np.zeros(width * block)
        for own, come in pieces:
            if own.num_rows:
                paths[_places(own, width, block)[0]] = own["value"].flatten().to_numpy()
            if come.num_rows:
                place, n = _places(come, width, block)
                share = come["value"].flatten().to_numpy()
                gained += np.bincount(place, share, width * block)
                if over_edges:
                    flow = np.add.reduceat(paths[place] * share, np.cumsum(n) - n)
                    some = np.flatnonzero(flow)
                    empty = [pa.nulls(len(some), pa.list_(x)) for x in (pa.int32(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), cell // parts)), come["v"].take(pa.array(some)), *empty, come["other"].take(pa.array(some)), pa.array(flow[some])], _LISTS)
        hit = np.flatnonzero(paths)
        if len(hit):
            flow = paths[hit] * gained[hit]
            yield _lists(cell, parts, width, block, hit, (1 + flow) / paths[hit], flow)


def _source_flows(starts: np.ndarray, ends: np.ndarray, sources: np.ndarray, over_edges: bool) -> tuple[np.ndarray, np.ndarray]:
    """What the shortest paths from sources bring where arcs from v go to ends[starts[v]:starts[v + 1]]: nodes that they reach, or arcs, and the flow of each."""
    n, degree = len(starts) - 1, np.diff(starts)
    flow, reached = np.zeros(len(ends) if over_edges else n), np.zeros(len(ends) if over_edges else n, dtype=bool)
    together = max(1, TASK_PAIRS // n)
    seen, slot = np.zeros(together * n, dtype=bool), np.zeros(together * n, dtype=np.int32)
    for low in range(0, len(sources), together):
        v = sources[low : low + together]
        base, paths, levels = np.arange(len(v), dtype=np.int32) * np.int32(n), np.ones(len(v)), []
        seen[:] = False
        seen[base + v] = True
        while len(v):
            d = degree[v]
            of = np.repeat(np.arange(len(v), dtype=np.int32), d)
            arc = np.arange(len(of), dtype=np.int32) + np.repeat(starts[v] - (np.cumsum(d, dtype=np.int32) - d), d)
            to = base[of] + ends[arc]
            new = ~seen[to]
            of, arc, to = of[new], arc[new], to[new]
            here = np.arange(len(to), dtype=np.int32)
            slot[to] = here
            first = slot[to] == here  # one of the arcs to each pair of the next level
            pair = to[first]
            slot[pair] = np.arange(len(pair), dtype=np.int32)
            seen[pair] = True
            place = slot[to]
            below = np.bincount(place, paths[of], len(pair))
            levels.append((v, paths, of, arc if over_edges else None, place, below))
            base = base[of[first]]
            v, paths = pair - base, below
        gained = np.zeros(0)
        for depth, (v, paths, of, arc, place, below) in reversed(list(enumerate(levels))):
            share = ((1 + gained) / below)[place] * paths[of]
            gained = np.bincount(of, share, len(v))
            if over_edges or depth:
                at, value = (arc, share) if over_edges else (v, gained)
                reached[at] = True
                if together == 1:
                    flow[at] += value
                else:
                    np.add.at(flow, at, value)
    hit = np.flatnonzero(reached)
    return hit, flow[hit]


def _from_sources(arcs: DataFrame, sources: DataFrame, n_nodes: int, n_sources: int, over_edges: bool) -> DataFrame:
    """Rows (v, other, flow) of _dependencies for a graph of TASK_ARCS arcs at most: it goes to each task as one row, and each has its share of the sources."""
    tasks = max(1, min(n_sources, 2 * arcs.sparkSession.sparkContext.defaultParallelism))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if own:
            t = pa.Table.from_batches(own)
            starts = np.searchsorted(t["from"].to_numpy(), np.arange(n_nodes + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (starts, t["to"].to_numpy().astype(np.int32))], ["starts", "ends"])

    def flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                starts, ends = (np.frombuffer(b[c][row].as_buffer(), np.int32) for c in ("starts", "ends"))
                hit, flow = _source_flows(starts, ends, b["sources"][row].values.to_numpy().astype(np.int32), over_edges)
                v, other = (np.searchsorted(starts, hit, "right") - 1, pa.array(ends[hit].astype(np.int64))) if over_edges else (hit, pa.nulls(len(hit), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), other, pa.array(flow)], ["v", "other", "flow"])

    graph = arcs.repartition(1).sortWithinPartitions("from").mapInArrow(pack, "starts binary, ends binary")
    dealt = sources.groupBy((F.col("at") % tasks).alias("task")).agg(F.collect_list("v").alias("sources")).repartitionByRange(tasks, "task")
    return dealt.crossJoin(F.broadcast(graph)).select("sources", "starts", "ends").mapInArrow(flows, "v long, other long, flow double")


def _dependencies(arcs: DataFrame, sources: DataFrame, n_nodes: int, n_sources: int, block: int, paths: list[str], over_edges: bool, whole: bool) -> DataFrame:
    """Rows (v, flow), or (v, other, flow) over edges: what the shortest paths from sources(v, at) bring; paths gets the tables written on the way. whole: tasks may hold the graph."""
    keys = ["v", "other"] if over_edges else ["v"]
    if whole:
        return _from_sources(arcs, sources, n_nodes, n_sources, over_edges).groupBy(*keys).agg(F.sum("flow").alias("flow"))
    width = max(1, CELL_PAIRS // block)
    parts = -(-max(n_nodes, 1) // width)
    tasks = max(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(parts * -(-n_sources // block)) // 8))

    def written(df: DataFrame) -> tuple[DataFrame, int]:
        out, path, n = materialize_counted(df, "level")
        paths.append(path)
        return out, n

    def met(known: DataFrame, come: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> tuple[DataFrame, int]:
        """What kernel makes of the rows of known and of those of come, sent to their neighbours, in cells."""
        sent = come.join(arcs, F.col("v") == F.col("from")).select("block", F.col("to").alias("v"), "source", "value", F.col("from").alias("other"), F.lit(1).alias("kind"))
        own = known.select("block", "v", "source", "value", F.lit(None).cast("long").alias("other"), F.lit(0).alias("kind"))
        rows = own.unionByName(sent).withColumn("cell", F.col("block") * parts + F.floor(F.col("v") / width))
        return written(rows.repartition(tasks, "cell").sortWithinPartitions("cell", "kind").mapInArrow(kernel, _LISTS_SCHEMA))

    level, n = written(
        sources.groupBy(F.floor(F.col("at") / block).alias("block"), "v").agg(F.collect_list((F.col("at") % block).cast("int")).alias("source"))
        .select("block", "v", "source", F.transform("source", lambda s: F.lit(1.0)).alias("value"), F.lit(None).cast("long").alias("other"), F.lit(0.0).alias("flow"))
    )
    levels = []
    while n:
        levels.append(level)
        known = level if len(levels) == 1 else level.unionByName(levels[-2])  # neighbours lie on this level or on one next to it
        level, n = met(known, level, lambda batches: _next_level(batches, parts, width, block))
    below, flows = level.limit(0), [level.limit(0)]
    for own in reversed(levels if over_edges else levels[1:]):
        out, _ = met(own, below, lambda batches: _level_back(batches, parts, width, block, over_edges))
        below = out.where("other is null")
        flows.append(out.where("other is not null") if over_edges else below)
    total = flows[0]
    for f in flows[1:]:
        total = total.unionByName(f)
    return total.groupBy(*keys).agg(F.sum("flow").alias("flow"))


# Ranks


#: A value for each of more nodes than this is joined by a shuffle, never broadcast: Spark goes by the file's size, which says little where values are alike.
JOINED_NODES = 100_000


def _shuffled(df: DataFrame, n_nodes: int) -> DataFrame:
    return df.hint("merge") if n_nodes > JOINED_NODES else df


def page_rank(arcs: DataFrame, nodes: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, rounds: int = 100, exact_rounds: bool = False) -> DataFrame:
    """Rows (id, rank) along arcs (src, dst): damped shares of the ends, and what leaks is dealt out evenly; stops when the ranks move less than tolerance."""
    spark = arcs.sparkSession
    out = arcs.groupBy("src").agg(F.count("*").alias("out"))
    arcs, arcs_path = materialize(arcs.join(out, "src"), "arcs")
    n = nodes.count()
    now, path = materialize(nodes.select("id", F.lit(1.0 / max(n, 1)).alias("rank")), "rank")
    for _ in range(rounds):
        got = arcs.join(_shuffled(now, n), F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.lit(damping) * F.col("rank") / F.col("out")).alias("got"))
        nxt, nxt_path = materialize(_shuffled(now, n).join(got, F.col("id") == F.col("dst"), "left").select("id", F.coalesce("got", F.lit(0.0)).alias("got"), F.col("rank").alias("old")), "rank")
        total = nxt.agg(F.sum("got")).first()[0] or 0.0
        leak = (1.0 - total) / max(n, 1)
        fresh = nxt.select("id", (F.col("got") + F.lit(leak)).alias("rank"), "old")
        moved = 1.0 if exact_rounds else (fresh.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0)
        discard(spark, path)
        now, path = fresh.select("id", "rank"), nxt_path
        if moved < tolerance:
            break
    return now


def hits(arcs: DataFrame, rounds: int = 20) -> DataFrame:
    """Rows (id, hub, authority) along arcs (src, dst), each normalised to length 1."""
    nodes = nodes_of(arcs)
    now, path = materialize(nodes.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")), "hits")
    for _ in range(rounds):
        a = arcs.join(now, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum("hub").alias("a"))
        mid, mid_path = materialize(_unit(nodes.join(a, F.col("id") == F.col("dst"), "left").select("id", F.coalesce("a", F.lit(0.0)).alias("authority")), "authority"), "hits")
        h = arcs.join(mid, F.col("dst") == F.col("id")).groupBy("src").agg(F.sum("authority").alias("h"))
        nxt, nxt_path = materialize(_unit(mid.join(h, F.col("id") == F.col("src"), "left").select("id", F.coalesce("h", F.lit(0.0)).alias("hub"), "authority"), "hub"), "hits")
        discard(arcs.sparkSession, path, mid_path)
        now, path = nxt, nxt_path
    return now


def _unit(df: DataFrame, column: str) -> DataFrame:
    norm = df.agg(F.sqrt(F.sum(F.col(column) * F.col(column)))).first()[0] or 1.0
    return df.withColumn(column, F.col(column) / F.lit(norm))


def eigenvector_centrality(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """Rows (id, value) of length 1, by power iteration."""
    adj, _ = materialize(both_ways(edges), "adj")
    now, path, n = materialize_counted(nodes_of(edges).select("id", F.lit(1.0).alias("value")), "eigen")
    for _ in range(rounds):
        got = adj.join(_shuffled(now, n), F.col("dst") == F.col("id")).groupBy("src").agg(F.sum("value").alias("v")).select(F.col("src").alias("id"), F.col("v").alias("value"))
        nxt, nxt_path = materialize(_unit(got, "value").join(_shuffled(now, n).select("id", F.col("value").alias("old")), "id"), "eigen")
        moved = nxt.agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0] or 0.0
        discard(edges.sparkSession, path)
        now, path = nxt.select("id", "value"), nxt_path
        if moved < tolerance:
            break
    return now


def degree_centrality(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return d.crossJoin(d.agg(F.count("*").alias("n"))).select("id", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


# Communities


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (modularity) of labels(id, community): inner edges and squared degree shares."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("c1")), labels.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    inner = edges.join(a, "src").join(b, "dst").where("c1 = c2").groupBy(F.col("c1").alias("community")).agg(F.count("*").alias("inner"))
    weight = degrees(edges).join(labels, "id").groupBy("community").agg(F.sum("degree").alias("d"))
    m = F.col("m").cast("double")
    each = weight.join(inner, "community", "left").crossJoin(edges.agg(F.count("*").alias("m")))
    return each.agg(F.sum(F.coalesce("inner", F.lit(0)) / m - F.pow(F.col("d") / (2 * m), F.lit(2.0))).alias("modularity"))


def edges_in_out(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (inside, outside): edges among nodes(id), and edges with one end there."""
    mark = nodes.select("id", F.lit(1).alias("x")).distinct()
    e = edges.join(mark.select(F.col("id").alias("src"), F.col("x").alias("a")), "src", "left").join(mark.select(F.col("id").alias("dst"), F.col("x").alias("b")), "dst", "left")
    ends = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
    return e.agg(F.sum((ends == 2).cast("long")).alias("inside"), F.sum((ends == 1).cast("long")).alias("outside"))


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Rows (id, community) by label propagation: a node takes its neighbours' most frequent label, ties to the least, for a fixed number of rounds."""
    adj, adj_path = materialize(both_ways(edges), "adj")
    now, path = materialize(nodes_of(edges).select("id", F.col("id").alias("community")), "community")
    for _ in range(rounds):
        votes = adj.join(now, F.col("dst") == F.col("id")).groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("community")).alias("c"))).alias("m"))
        nxt, nxt_path = materialize(best.select(F.col("src").alias("id"), (-F.col("m.c")).alias("community")), "community")
        discard(edges.sparkSession, path)
        now, path = nxt, nxt_path
    discard(edges.sparkSession, adj_path)
    return now


def graph_statistics(edges: DataFrame) -> DataFrame:
    """One row of scalar statistics of an undirected graph."""
    c, _ = materialize(clustering(edges), "stats")
    sizes, _ = materialize(component_sizes(edges), "sizes")
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    base = c.agg(
        F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"),
        F.avg("cc").alias("mean_clustering"), (F.sum("triangles") / 3).cast("long").alias("triangles"), F.sum(pairs).cast("long").alias("wedges"),
    )
    comp = sizes.agg(F.count("*").alias("components"), F.max("nodes").alias("largest_component"))
    return base.crossJoin(comp)


def more_statistics(edges: DataFrame) -> DataFrame:
    """One row: leaves (degree 1), density, transitivity, share of nodes in a triangle, and share of the largest component."""
    c, path = materialize(clustering(edges), "stats")
    n, pairs = F.count("*"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2)
    base = c.agg(
        F.sum((F.col("degree") == 1).cast("long")).alias("leaves"), (F.sum("degree") / F.nullif(n * (n - 1), F.lit(0))).alias("density"), (F.sum("triangles") / F.nullif(pairs, F.lit(0))).alias("transitivity"),
        F.avg((F.col("triangles") > 0).cast("double")).alias("in_triangles"), n.alias("n"),
    )
    return base.crossJoin(component_sizes(edges).agg(F.max("nodes").alias("top"))).select("leaves", "density", "transitivity", "in_triangles", (F.col("top") / F.col("n")).alias("largest_share"))


def distributions(edges: DataFrame) -> DataFrame:
    """Rows (name, x, y): nodes by degree, components by size, mean clustering and mean neighbour degree by degree, and nodes by number of triangles."""
    c, _ = materialize(clustering(edges), "stats")
    row = lambda name, x, y: (F.lit(name).alias("name"), F.col(x).cast("long").alias("x"), F.col(y).cast("double").alias("y"))
    near = both_ways(edges).join(c.select(F.col("id").alias("dst"), F.col("degree").alias("d2")), "dst").groupBy("src").agg(F.avg("d2").alias("k")).join(c.select(F.col("id").alias("src"), "degree"), "src")
    parts = [
        c.groupBy("degree").agg(F.count("*").alias("n")).select(*row("degree", "degree", "n")), component_sizes(edges).groupBy("nodes").agg(F.count("*").alias("n")).select(*row("component", "nodes", "n")),
        c.groupBy("degree").agg(F.avg("cc").alias("m")).select(*row("clustering", "degree", "m")), near.groupBy("degree").agg(F.avg("k").alias("m")).select(*row("neighbour_degree", "degree", "m")),
        c.groupBy("triangles").agg(F.count("*").alias("n")).select(*row("triangles", "triangles", "n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def neighbourhood_function(edges: DataFrame, depth: int) -> DataFrame:
    """Rows (hop, pairs): approximate numbers of pairs within a hop, from a sketch a node that neighbours merge round by round."""
    adj, _ = materialize(both_ways(edges), "adj")
    now, _ = materialize(nodes_of(edges).groupBy("id").agg(F.hll_sketch_agg(F.col("id"), F.lit(10)).alias("sketch")), "anf")
    out = now.agg(F.lit(0).alias("hop"), F.sum(F.hll_sketch_estimate("sketch")).alias("pairs"))
    for hop in range(1, depth + 1):
        grown = adj.join(now, F.col("dst") == F.col("id")).select(F.col("src").alias("id"), "sketch").union(now.select("id", "sketch"))
        now, _ = materialize(grown.groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch")), "anf")
        out = out.union(now.agg(F.lit(hop).alias("hop"), F.sum(F.hll_sketch_estimate("sketch")).alias("pairs")))
    return out


# Generators


def _u(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def grid(spark, rows: int, columns: int) -> DataFrame:
    cell = spark.range(rows * columns)
    right = cell.where(F.col("id") % columns < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return right.union(cell.where(F.col("id") < (rows - 1) * columns).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst")))


def star(spark, n: int) -> DataFrame:
    return spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))


def circle(spark, n: int) -> DataFrame:
    return edges_from(spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b")), "a", "b")


def complete(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n).cast("long"))).alias("dst")).where(F.col("dst") < n)


def tree(spark, fan: int, levels: int) -> DataFrame:
    n = sum(fan**i for i in range(levels))
    return spark.range(1, n).select(F.floor((F.col("id") - 1) / fan).alias("src"), F.col("id").alias("dst"))


def random_edges(spark, n: int, m: int, seed: int) -> DataFrame:
    """About m distinct edges among n nodes, drawn evenly; those drawn twice or as loops are dropped."""
    draw = spark.range(m).select(F.floor(_u(F.col("id"), F.lit(seed), F.lit(1)) * n).alias("a"), F.floor(_u(F.col("id"), F.lit(seed), F.lit(2)) * n).alias("b"))
    return edges_from(draw, "a", "b")


def r_mat(spark, levels: int, m: int, a: float, b: float, c: float, seed: int) -> DataFrame:
    """Directed arcs of a recursive matrix: each level picks a quadrant with probabilities a, b, c and the rest."""
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in range(levels):
        u = _u(F.col("id"), F.lit(seed), F.lit(level))
        src = src * 2 + (u >= a + b).cast("long")
        dst = dst * 2 + ((u >= a) & (u < a + b) | (u >= a + b + c)).cast("long")
    return spark.range(m).select(src.alias("src"), dst.alias("dst")).distinct()


def bipartite(spark, left: int, right: int, m: int, seed: int) -> DataFrame:
    """About m distinct arcs from 0 .. left - 1 to left .. left + right - 1, drawn evenly."""
    draw = lambda n, k: F.floor(_u(F.col("id"), F.lit(seed), F.lit(k)) * n)
    return spark.range(m).select(draw(left, 1).alias("src"), (draw(right, 2) + left).alias("dst")).distinct()


def hierarchical(spark, levels: int) -> DataFrame:
    """A hierarchical network of 5**levels nodes: cliques of five, of which each level's outer nodes are linked with the centre of five modules put together.

    Numbers in base 5 tell the module; the centre of a module is its member of zeros, and its outer nodes have no zero in it.
    """
    node = spark.range(5**levels)
    inner = node.select("id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step")).where(F.col("id") % 5 + F.col("step") < 5)
    out = inner.select(F.col("id").alias("src"), (F.col("id") + F.col("step")).alias("dst"))
    for level in range(1, levels):
        digits = [F.floor(F.col("id") / 5**i) % 5 != 0 for i in range(level + 1)]
        outer = digits[0]
        for d in digits[1:]:
            outer = outer & d
        out = out.unionByName(node.where(outer).select((F.col("id") - F.col("id") % 5 ** (level + 1)).alias("src"), F.col("id").alias("dst")))
    return out


def regular(spark, n: int, k: int, seed: int) -> DataFrame:
    """A random graph of n nodes of degree k, less the loops and repeats that the matching gives."""
    return configuration_model(spark.range(n).withColumn("degree", F.lit(k)), seed)


def power_law(spark, n: int, exponent: float, most: int, seed: int) -> DataFrame:
    """A random graph whose degrees follow a power law up to `most`, less loops and repeats."""
    u = _u(F.col("id"), F.lit(seed), F.lit(3))
    degree = F.least(F.floor(F.pow(1 - u * (1 - float(most) ** (1 - exponent)), F.lit(1 / (1 - exponent)))), F.lit(most))
    return configuration_model(spark.range(n).withColumn("degree", degree.cast("int")), seed)


def rewired(edges: DataFrame, rounds: int, seed: int) -> DataFrame:
    """Edges with ends swapped at random, all degrees kept: in a round random pairs (a, b), (c, d) become (a, d), (c, b), unless that makes a loop or an edge that is there already."""
    from gleaner.operators.table import row_numbers

    now = edges.select("src", "dst")
    for i in range(rounds):
        flip = F.xxhash64("src", "dst", F.lit(seed + i), F.lit(1)) % 2 == 0
        mixed = now.withColumn("u", F.xxhash64("src", "dst", F.lit(seed + i))).withColumn("a", F.when(flip, F.col("src")).otherwise(F.col("dst"))).withColumn("b", F.when(flip, F.col("dst")).otherwise(F.col("src")))
        placed = row_numbers(mixed, ["u", "src", "dst"], "at").withColumn("pair", F.floor(F.col("at") / 2))
        old, new = F.sort_array(F.collect_list(F.struct("at", "src", "dst", "a", "b"))), F.col("e")
        pairs, path = materialize(placed.groupBy("pair").agg(old.alias("e")), "pairs")
        made = F.array(*(F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")) for x, y in ((new[0]["a"], new[1]["b"]), (new[1]["a"], new[0]["b"]))))
        tried = pairs.where(F.size("e") == 2).select("pair", F.explode(made).alias("n")).select("pair", "n.src", "n.dst")
        twice = tried.groupBy("src", "dst").agg(F.count("*").alias("k"))
        bad = tried.join(twice, ["src", "dst"]).join(now.withColumn("there", F.lit(True)), ["src", "dst"], "left").where("src = dst or k > 1 or there").select("pair").distinct()
        good = tried.join(bad, "pair", "left_anti").select("src", "dst")
        kept = pairs.join(bad, "pair", "left_semi").unionByName(pairs.where(F.size("e") < 2)).select(F.explode("e").alias("o")).select("o.src", "o.dst")
        now, _ = materialize(good.unionByName(kept), "rewired")
        discard(edges.sparkSession, path)
    return now


def configuration_model(degree: DataFrame, seed: int) -> DataFrame:
    """Edges by random matching of the stubs of degree(id, degree); loops and repeats are dropped."""
    from gleaner.operators.table import row_numbers

    stubs = degree.select("id", F.explode(F.sequence(F.lit(1), F.col("degree").cast("int"))).alias("k")).withColumn("u", F.xxhash64("id", "k", F.lit(seed)))
    placed = row_numbers(stubs, ["u", "id", "k"], "at")
    half = placed.groupBy(F.floor(F.col("at") / 2).alias("pair")).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    return edges_from(half.where("n = 2"), "a", "b")


def growth_graph(n: int, fan: int, seed: int, kind: str = "preferential", p: float = 0.5) -> pd.DataFrame:
    """Edges of a grown graph, which is sequential by nature: preferential attachment (also geometric: among near points only), copying, forest fire or small world."""
    rng = np.random.Generator(np.random.PCG64(seed))
    edges: set[tuple[int, int]] = set()
    near: list[set[int]] = [set() for _ in range(n)]

    def link(a: int, b: int) -> None:
        if a != b:
            edges.add((min(a, b), max(a, b)))
            near[a].add(b)
            near[b].add(a)

    if kind == "small_world":
        for v in range(n):
            for j in range(1, fan + 1):
                link(v, int(rng.integers(n)) if rng.random() < p else (v + j) % n)
        return pd.DataFrame(sorted(edges), columns=["src", "dst"])
    ends: list[int] = [0]
    place = rng.normal(size=(n, 3))
    place /= np.linalg.norm(place, axis=1, keepdims=True)
    for v in range(1, n):
        if kind == "preferential":
            for _ in range(min(fan, v)):
                t = ends[int(rng.integers(len(ends)))]
                link(v, t)
                ends += [v, t]
        elif kind == "geometric":  # p: the radius within which a point sees others, all if there are none
            near_by = np.flatnonzero(np.linalg.norm(place[:v] - place[v], axis=1) <= p)
            near_by = near_by if len(near_by) else np.arange(v)
            weight = np.array([len(near[t]) + 1.0 for t in near_by])
            for t in rng.choice(near_by, size=min(fan, len(near_by)), replace=False, p=weight / weight.sum()).tolist():
                link(v, t)
        elif kind == "copying":
            model = int(rng.integers(v))
            link(v, model)
            for t in sorted(near[model])[:fan]:
                link(v, t if rng.random() < p else int(rng.integers(v)))
        elif kind == "forest_fire":
            burnt, queue = set(), [int(rng.integers(v))]
            while queue and len(burnt) < 50 * fan:
                t = queue.pop(0)
                if t in burnt:
                    continue
                burnt.add(t)
                fresh = sorted(near[t] - burnt)
                spread = min(len(fresh), int(rng.geometric(1 - p)) - 1)
                queue += [int(x) for x in rng.permutation(fresh)[:spread]] if spread else []
            for t in burnt:
                link(v, t)
        else:
            raise ValueError(kind)
    return pd.DataFrame(sorted(edges), columns=["src", "dst"])
